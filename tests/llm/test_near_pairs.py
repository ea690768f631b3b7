"""Pairs are thinned where they meet, and verified without a vector for each pair."""

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import neighbours, vectors


def test_pairs_that_only_meet_do_not_leave_their_bucket(spark):
    """All vectors lie in the same buckets at a similarity of about .5; 20 have a near copy."""
    size, n = 32, 400
    rng = np.random.default_rng(4)
    x = np.ones((n, size)) + rng.standard_normal((n, size))
    x[:20] = x[20:40] + 0.1 * rng.standard_normal((20, size))
    df = spark.createDataFrame([(f"p{i:03d}", [float(t) for t in v], "m") for i, v in enumerate(x)], "post_id string, embedding array<float>, embedding_model string").withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    reps, members = vectors.representatives(*vectors.usable_vectors(df, size=size))
    key = {r.rid: r.key for r in members.collect()}
    near, hot = neighbours.near_pairs(reps, neighbours.Hashing(tables=2, functions=2, width=1000.0, probes=2), size, 0.8)
    assert hot is None and near.count() < 0.1 * n * n
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(f"p{i:03d}", f"p{j:03d}") for i, j in np.argwhere(u @ u.T >= 0.8) if i < j}
    got = {tuple(sorted((key[r.a], key[r.b]))) for r in neighbours.verified(near, reps.select("rid", "vec"), 0.8).collect()}
    assert len(want) >= 20 and len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(got)
