"""What a step took on disk is gone when its result is written; pairs are verified by either way with the same rows."""

import os
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import neighbours, vectors
from quillmark.session import CLEANUP, materialise


def shuffle_files(spark):
    return {p for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for p in Path(d).rglob("shuffle_*.data")}


def usable(spark, x):
    df = spark.createDataFrame([(f"p{i:03d}", [float(t) for t in v], "m") for i, v in enumerate(x)], "post_id string, embedding array<float>, embedding_model string").withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    return vectors.representatives(*vectors.usable_vectors(df, size=x.shape[1]))


def drawn(n=300, size=32):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((n, size))
    x[: n // 3] = x[n // 3 : 2 * (n // 3)] + 0.2 * rng.standard_normal((n // 3, size))
    return x


def test_shuffle_files_go_with_the_step(spark):
    before, kept = shuffle_files(spark), spark.conf.get(CLEANUP, None)
    out = materialise(spark.range(0, 5000, 1, 4).groupBy((F.col("id") % 500).alias("k")).agg(F.count("*").alias("n")), "freed")
    until = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(CLEANUP, None) == kept and out.count() == 500


def test_broadcast_files_go_with_the_pass(spark):
    reps, _ = usable(spark, drawn())
    seen = []
    for shared in vectors.passes(reps.select("rid", "vec"), block=100):
        assert all(not os.path.exists(p) for p in seen)
        seen.append(shared._path)
    assert len(seen) == 3 and all(not os.path.exists(p) for p in seen)


def test_a_pair_of_several_tables_is_kept_once(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "TABLE_ROWS", 1)
    reps, _ = usable(spark, drawn())
    near, _ = neighbours.near_pairs(reps, neighbours.Hashing(tables=3, functions=2, width=1000.0, probes=2), 32, 0.8)
    assert near.count() == near.distinct().count() >= 100


def test_both_ways_of_verifying_agree(spark, monkeypatch):
    """In three rounds with broadcast row numbers, in three without, and against blocks of all vectors."""
    x = drawn()
    reps, members = usable(spark, x)
    v = reps.select("rid", "vec")
    ids = reps.select("rid")
    near = materialise(ids.withColumnRenamed("rid", "a").crossJoin(ids.withColumnRenamed("rid", "b")).filter("a < b and pmod(xxhash64(a, b), 3) <> 0"), "some-pairs")
    rows = lambda df: sorted((r.a, r.b, r.similarity) for r in df.collect())
    want = rows(neighbours.verified_by_blocks(near, v, 0.8))
    assert len(want) >= 40 and rows(neighbours.verified_by_pairs(near, v, 0.8, 3)) == want
    monkeypatch.setattr(neighbours, "BROADCAST_ROWS", 10)
    assert rows(neighbours.verified_by_pairs(near, v, 0.8, 3)) == want
    key = {r.rid: int(r.key[1:]) for r in members.collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for a, b, s in want:
        assert abs(float(u[key[a]] @ u[key[b]]) - s) < 1e-4


def test_the_way_with_fewer_rounds_is_taken(spark, monkeypatch):
    reps, _ = usable(spark, drawn())
    v = reps.select("rid", "vec")
    near = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    taken = []
    monkeypatch.setattr(neighbours, "verified_by_pairs", lambda *a: taken.append(("pairs", a[-1])))
    monkeypatch.setattr(neighbours, "verified_by_blocks", lambda *a: taken.append(("blocks", 0)))
    neighbours.verified(near, v, 0.8)
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    neighbours.verified(near, v, 0.8)
    many = spark.range(700).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    neighbours.verified(many, v, 0.8)
    neighbours.verified(many.unionAll(many).unionAll(many), v, 0.8)
    assert taken == [("blocks", 0), ("pairs", 1), ("pairs", 3), ("blocks", 0)]
