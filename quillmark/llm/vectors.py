"""Usable vectors of posts, in a compact columnar table shared by problems 1 and 6."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.latest import latest_by
from quillmark.session import materialise, ship_package

SCALE = 32767.0
#: Rows up to which a list of row numbers is broadcast (16 bytes each); beyond, it is joined by shuffle.
BROADCAST_ROWS = 200_000

#: Vectors of one broadcast (50 MB).
BLOCK = 65_536


def small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to be small enough, else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors (float32) of a column of packed ones."""
    if not len(column):
        return np.zeros((0, 1), np.float32)
    return unpacked(np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), -1))


def unpacked(packed: np.ndarray) -> np.ndarray:
    """Unit vectors (float32) of packed ones."""
    return packed.astype(np.float32) * np.float32(1 / SCALE)


def pack(lists: pa.Array, size: int) -> tuple[list[bytes | None], list[bytes | None]]:
    """Packed unit vectors and their digests; null where a list is null, of another length, not finite or all zero."""
    n = len(lists)
    out: list[bytes | None] = [None] * n
    digests: list[bytes | None] = [None] * n
    fits = pc.fill_null(pc.equal(pc.list_value_length(lists), size), False).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(fits)
    if len(at):
        flat = pc.list_flatten(lists.take(pa.array(at)))
        x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
        with np.errstate(all="ignore"):
            top = np.abs(x).max(1)
            good = np.isfinite(top) & np.isfinite(x).all(1) & (top > 0)
            x = x / np.where(good, top, 1)[:, None]  # first by the largest, so that no square overflows
            x = x / np.sqrt((x * x).sum(1))[:, None]
        q = np.rint(np.where(good[:, None], x, 0) * SCALE).astype(np.int16)
        for i, ok, row in zip(at, good, q):
            if ok:
                out[i] = row.tobytes()
                digests[i] = hashlib.blake2b(out[i], digest_size=16).digest()
    return out, digests


def usable_vectors(df: DataFrame, *, key: str = "post_id", column: str = "embedding", model: str = "embedding_model", time: str = "updated_at", size: int = 384, extra: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Packed vectors ``(rid, model, vec)`` and ``(rid, key, model, h, extra)`` of the posts that have a usable one.

    A vector is usable if the post's latest row has ``size`` finite numbers that
    are not all zero. Vectors are scaled to unit length and kept as 16-bit fixed
    point; a similarity computed from them is off by less than 5e-5. ``h`` is a
    digest of the vector. The vectors are written once, without a shuffle; the
    latest row is found from narrow columns. A null model counts as one model.
    """
    ship_package(df.sparkSession)
    kinds = dict(df.dtypes)
    more = F.lit(None).cast("string") if extra is None else F.col(extra).cast("string")
    rows = df.select(F.col(key).cast("string").alias("key"), F.coalesce(F.col(model).cast("string"), F.lit("")).alias("model"), F.col(time).alias("at"), more.alias("extra"), F.col(column).cast("array<float>").alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, h = pack(b.column(4), size)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(h, pa.binary()), pa.array(vec, pa.binary())], names=["key", "model", "at", "extra", "h", "vec"])

    packed = rows.mapInArrow(run, f"key string, model string, at {kinds[time]}, extra string, h binary, vec binary")
    stored = materialise(packed.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    heads = latest_by(stored.select("rid", "key", "model", "at", "extra", "h"), ["key"], "at", [F.col("h"), F.col("rid")]).filter("h is not null")
    return stored.select("rid", "model", "vec"), materialise(heads.select("rid", "key", "model", "h", "extra"), "vector-heads")


def slices(b: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Small pieces of a batch, so that what is computed from one stays small too."""
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def passes(rows: DataFrame, *order: str, block: int = BLOCK) -> Iterator[Broadcast]:
    """All of ``rows`` in broadcasts of about ``block`` rows, for comparing every row with every other without a shuffle.

    ``rows`` holds rid, vec and the columns of ``order``; a broadcast is a dict of
    the other columns as arrays and the packed vectors, sorted by ``order`` and
    rid. It and its files are dropped when the next one is asked for, so what is
    computed from it must be written before.
    """
    n = max(1, -(-rows.count() // block))
    for i in range(n):
        shared = share(rows.filter(F.pmod(F.xxhash64("rid"), F.lit(n)) == i), *order)
        yield shared
        shared.destroy()


def share(rows: DataFrame, *order: str) -> Broadcast:
    """All of ``rows`` in one broadcast, as in ``passes``."""
    t = rows.select(*order, "rid", "vec").toArrow().sort_by([(c, "ascending") for c in (*order, "rid")])
    packed = np.frombuffer(b"".join(x.as_py() for x in t.column("vec")), np.int16).reshape(t.num_rows, -1 if t.num_rows else 1)
    return rows.sparkSession.sparkContext.broadcast(({c: t.column(c).to_numpy() for c in (*order, "rid")}, packed))


def shares(counts: list[tuple[int, int]], block: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of groups of about ``block`` rows: first and last group, parts; ``counts`` has the rows of each group, in order.

    Only a group of more rows stands alone and has several parts.
    """
    first = last = None
    held = 0
    for g, n in counts:
        if first is not None and held + n > block:
            yield first, last, max(1, -(-held // block))
            first, held = None, 0
        first, last, held = g if first is None else first, g, held + n
    if first is not None:
        yield first, last, max(1, -(-held // block))


def only(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``vectors`` whose ``rid`` is in ``ids``.

    What is to go is usually little: then its row numbers are broadcast and no
    vector travels. Else the rows are joined once and written.
    """
    out = materialise(vectors.select("rid").join(ids.select("rid"), "rid", "left_anti"), "left-out")
    few = out.count() <= BROADCAST_ROWS
    kept = vectors.join(F.broadcast(out) if few else out, "rid", "left_anti")
    return kept if few else materialise(kept, "vectors-kept")


def representatives(vectors: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups of identical vectors of a model: the vectors of the representatives, and ``(rid, rep, key)`` of all posts."""
    groups = heads.groupBy("model", "h").agg(F.min("rid").alias("rep"))
    members = materialise(heads.join(groups, ["model", "h"]).select("rid", "rep", "key"), "vector-groups")
    return only(vectors, members.filter("rid = rep")), members
