"""Joins of collected pages: candidates, details, owners, authors, caches, citations."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillmark.operators.similarity import batches_of


def candidates(found: DataFrame, group: str, key: str, query: str) -> DataFrame:
    """One row for each (group, key) with all queries that found it, sorted."""
    return found.dropna(subset=[key]).groupBy(group, key).agg(F.sort_array(F.collect_set(query)).alias("discovered_by"))


def hydrated(found: DataFrame, details: DataFrame, key: str, available: DataFrame | None = None, owner: str = "channel_id", relevant: str | None = None) -> DataFrame:
    """Candidates with their details; those without, those of unknown owners and those judged irrelevant are dropped, unjudged ones stay."""
    out = found.join(details, key)
    if relevant:
        out = out.filter(~F.col(relevant).eqNullSafe(F.lit(False)))
    return out if available is None else out.join(available.select(owner).distinct(), owner, "left_semi")


def owned(posts: DataFrame, selection: DataFrame, videos: str = "video_ids", key: str = "video_id") -> DataFrame:
    """Posts with the columns of the selected row that lists their video; posts of other videos have nulls.

    A video listed twice belongs to the first row in order of its columns.
    """
    rest = [c for c in selection.columns if c != videos]
    one = selection.select(F.explode(videos).alias(key), *rest).groupBy(key).agg(F.min(F.struct(*rest)).alias("s"))
    return posts.join(one, key, "left").select(*posts.columns, *[F.col(f"s.{c}").alias(c) for c in rest])


def cached(df: DataFrame, cache: DataFrame, keys: list[Column], value: str, key: str = "key") -> DataFrame:
    """``df`` with ``value`` of the first of its ``keys`` that the cache holds, and ``level``, the number of that key (0: none).

    Each key is one equi-join; a null key finds nothing. The cache has one row for
    each key.
    """
    out = df
    for i, k in enumerate(keys):
        side = cache.select(F.col(key).alias(f"__k{i}"), F.col(value).alias(f"__v{i}"))
        out = out.withColumn(f"__h{i}", k).join(side, F.col(f"__h{i}") == F.col(f"__k{i}"), "left")
    level = F.lit(0)
    for i in reversed(range(len(keys))):
        level = F.when(F.col(f"__k{i}").isNotNull(), i + 1).otherwise(level)
    return out.select(*df.columns, F.coalesce(*[F.col(f"__v{i}") for i in range(len(keys))]).alias(value), level.alias("level"))


def cited(answers: DataFrame, evidence: DataFrame, cites: str, key: str) -> DataFrame:
    """Citations of each answer that are in the evidence, each once; others are dropped."""
    rest = [c for c in answers.columns if c != cites]
    return answers.select(*rest, F.explode(F.array_distinct(cites)).alias(key)).join(evidence.select(key).distinct(), key, "left_semi").select(*rest, key)


def answered(df: DataFrame, call: Callable[[pa.RecordBatch], pa.Array], name: str, kind: str, at_once: int = 25) -> DataFrame:
    """``df`` with a column of answers of any model, asked for in batches of ``at_once`` rows of a task.

    ``call`` gets a batch and returns one answer for each of its rows, null where
    there is none; if it fails, the batch has no answers and the rest goes on. The
    function is shipped to the tasks, so a model is loaded where it is first used.
    """
    schema = ", ".join([*(f"`{c}` {k}" for c, k in df.dtypes), f"`{name}` {kind}"])
    nothing = to_arrow_type(df.sparkSession.createDataFrame([], f"x {kind}").schema["x"].dataType)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches, at_once):
            if not b.num_rows:
                continue
            try:
                got = call(b)
            except Exception:  # noqa: BLE001 - a failing model must not end the job
                got = pa.nulls(b.num_rows, nothing)
            yield pa.RecordBatch.from_arrays([*b.columns, got], names=[*b.schema.names, name])

    return df.mapInArrow(run, schema)


def stale(df: DataFrame, vector: Column, model: Column, wanted: str, text_hash: Column, own_hash: Column, size: int = 384) -> DataFrame:
    """``df`` with ``stale``: why a stored vector must be made again (length, model, text), null where it need not."""
    why = F.when(vector.isNull() | (F.size(vector) != size), "length").when(~model.eqNullSafe(wanted), "model").when(~text_hash.eqNullSafe(own_hash), "text")
    return df.withColumn("stale", why)
