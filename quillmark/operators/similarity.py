"""Vector search, centroids, communities and hashed trigram vectors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.math import dot, norm


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Unit-length sum of the vectors of each group.

    Positions are summed by (group, position), which partial aggregation reduces
    before the shuffle, so a group of any size is fine.
    """
    sums = df.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    total = sums.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return total.withColumn("n", norm(F.col("v"))).filter("n > 0").select(group, F.transform("v", lambda x: x / F.col("n")).alias("centroid"))


def nearest_centroid(df: DataFrame, key: str, vector: str, cents: DataFrame, group: str, floor: float, margin: float, most: int = 10_000) -> DataFrame:
    """Nearest centroid of each row; ``group`` is null below ``floor`` or without a lead of ``margin`` over the second.

    Centroids are counted, then compared in blocks of at most ``most``, each sent
    to the tasks once: a row is read, multiplied with the block and leaves with its
    two best, so nothing is shuffled. Only where there are several blocks are
    these few rows for a key merged. Ties go to the smaller group. Without
    centroids, and for null vectors, there is no row.
    """
    kinds = dict(df.dtypes)
    blocks = max(1, -(-cents.count() // most))
    label = cents.schema[group].dataType.simpleString()
    two = f"`{key}` {kinds[key]}, g1 {label}, s1 double, s2 double"
    parts = None
    for i in range(blocks):
        block = cents if blocks == 1 else cents.filter(F.pmod(F.xxhash64(group), F.lit(blocks)) == i)
        t = block.select(group, F.col("centroid").cast("array<double>").alias("c")).toArrow().sort_by(group)
        if not t.num_rows:
            continue
        names = t.column(0).combine_chunks()
        shared = df.sparkSession.sparkContext.broadcast((names, np.stack(t.column(1).to_numpy())))
        found = df.select(key, F.col(vector).cast("array<double>").alias("v")).filter("v is not null").mapInArrow(_best_two(shared, key), two)
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {kinds[key]}, `{group}` {label}, similarity double")
    if blocks > 1:
        first = F.min_by(F.struct("g1", "s1"), F.struct(-F.col("s1"), F.col("g1")))
        scores = F.sort_array(F.flatten(F.collect_list(F.array("s1", "s2"))), asc=False)
        parts = parts.groupBy(key).agg(first.alias("b"), scores.alias("s")).select(key, F.col("b.g1").alias("g1"), F.col("b.s1").alias("s1"), F.col("s")[1].alias("s2"))
    ok = (F.col("s1") >= floor) & (F.col("s2").isNull() | (F.col("s1") - F.col("s2") >= margin))
    return parts.select(key, F.when(ok, F.col("g1")).alias(group), F.col("s1").alias("similarity"))


def _best_two(shared, key: str):  # noqa: ANN001, ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c = shared.value
        for whole in batches:
            for b in batches_of([whole], 2048):
                s = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1) @ c.T
                best = s.argmax(1)
                top = s[np.arange(len(s)), best]
                second = np.partition(s, -2, 1)[:, -2] if s.shape[1] > 1 else np.full(len(s), np.nan)
                yield pa.RecordBatch.from_arrays([b.column(0), names.take(pa.array(best)), pa.array(top), pa.array(second, mask=np.isnan(second))], names=[key, "g1", "s1", "s2"])

    return run


def pairs_above(df: DataFrame, key: str, vector: str, least: float, block: int = 2000) -> DataFrame:
    """All pairs (a < b) of rows with a dot product of ``least`` or more, by matrix products of blocks.

    Exact and therefore quadratic; meant for tables of thousands. Each row is
    sent to one task for each block, and no pair is made that is not a result.
    """
    n = df.count()
    blocks = max(1, -(-n // block))
    side = df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v")).withColumn("blk", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int"))
    left = side.select(F.col("blk").alias("i"), F.explode(F.sequence("blk", F.lit(blocks - 1))).alias("j"), F.lit(0).alias("side"), "k", "v")
    right = side.select(F.explode(F.sequence(F.lit(0), F.col("blk"))).alias("i"), F.col("blk").alias("j"), F.lit(1).alias("side"), "k", "v")

    def compare(t: pa.Table) -> pa.Table:
        s, k = t.column("side").to_numpy(), t.column("k").to_numpy()
        v = t.column("v").combine_chunks()
        x = v.flatten().to_numpy().reshape(len(v), -1)
        a, b = np.flatnonzero(s == 0), np.flatnonzero(s == 1)
        m = x[a] @ x[b].T
        p, q = np.nonzero(m >= least)
        u, w, sim = k[a[p]], k[b[q]], m[p, q]
        same_block = t.column("i")[0].as_py() == t.column("j")[0].as_py() if len(t) else False
        keep = u < w if same_block else u != w
        return pa.Table.from_arrays([pa.array(np.minimum(u, w)[keep]), pa.array(np.maximum(u, w)[keep]), pa.array(sim[keep])], names=["a", "b", "similarity"])

    kind = dict(df.dtypes)[key]
    return left.unionByName(right).groupBy("i", "j").applyInArrow(compare, f"a {kind}, b {kind}, similarity double")


def top_similar(df: DataFrame, key: str, vector: str, query: list[float], k: int = 70) -> DataFrame:
    """The ``k`` rows most similar to a query vector; a bounded heap in each task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.select(key, dot(F.col(vector), q).alias("similarity")).orderBy(F.desc("similarity"), key).limit(k)


def communities(df: DataFrame, group: str, key: str, vector: str, least: float, least_size: int = 3) -> DataFrame:
    """Greedy communities within each group: rows by number of neighbours, each taking its free neighbours.

    A sequential rule, so a group is one task; groups are meant to be single runs
    of a source with some thousands of rows. ``topic`` is -1 for outliers,
    ``probability`` the similarity to the community's centre.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(key, kind="stable").reset_index(drop=True)
        x = np.stack(p[vector].to_numpy()).astype(float)
        s = x @ x.T >= least
        order = sorted(range(len(p)), key=lambda i: (-int(s[i].sum()), i))
        topic = np.full(len(p), -1)
        prob = np.zeros(len(p))
        n = 0
        for i in order:
            if topic[i] >= 0:
                continue
            own = np.flatnonzero(s[i] & (topic < 0))
            if len(own) >= least_size:
                topic[own] = n
                c = x[own].sum(0)
                prob[own] = x[own] @ (c / np.linalg.norm(c))
                n += 1
        return pd.DataFrame({group: p[group], key: p[key], "topic": topic.astype("int32"), "probability": prob})

    kinds = dict(df.dtypes)
    return df.select(group, key, vector).groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, topic int, probability double")


def trigram_vectors(df: DataFrame, key: str, text: str, size: int = 384) -> DataFrame:
    """Hashed TF-IDF vectors of character trigrams, unit length, as sorted (bucket, weight) pairs."""
    word = F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))
    w = df.select(key, word.alias("w")).select(key, F.concat(F.lit("<"), "w", F.lit(">")).alias("w"))
    tri = w.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("t"))
    tf = tri.groupBy(key, F.pmod(F.crc32("t"), F.lit(size)).cast("int").alias("bucket")).agg(F.count("*").alias("tf"))
    dfreq = tf.groupBy("bucket").agg(F.count("*").alias("df"))
    n = df.agg(F.count("*").alias("n"))
    x = tf.join(F.broadcast(dfreq), "bucket").crossJoin(F.broadcast(n)).withColumn("x", F.log(1 + F.col("tf")) * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))
    g = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"), F.array_sort(F.collect_list(F.struct("bucket", "x"))).alias("v"))
    return g.select(key, F.transform("v", lambda s: F.struct(s["bucket"].alias("bucket"), (s["x"] / F.col("len")).alias("weight"))).alias("vector"))


def batches_of(it: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Record batches cut to at most ``size`` rows, for scorers with a batch limit."""
    for b in it:
        for i in range(0, b.num_rows, size):
            yield b.slice(i, size)
