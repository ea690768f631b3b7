"""Groups are compared exactly, part by part, with what they give bounded; copied vectors are deleted."""

import os

import numpy as np
from pyspark.sql import functions as F

from quillmark.llm import neighbours, vectors

SIZE = 32


def unit(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def packed(x):
    return np.rint(unit(x) * vectors.SCALE).astype(np.int16)


def stored(spark, x):
    rows = [(i, v.tobytes()) for i, v in enumerate(packed(x))]
    return neighbours.materialise(spark.createDataFrame(rows, "rid bigint, vec binary"), "some-vectors")


def usable(spark, x):
    df = spark.createDataFrame([(f"p{i:03d}", [float(t) for t in v], "m") for i, v in enumerate(x)], "post_id string, embedding array<float>, embedding_model string").withColumn("updated_at", F.lit("2026-01-01").cast("timestamp"))
    return vectors.usable_vectors(df, size=SIZE)


def drawn(n, seed=3):
    return np.ones((n, SIZE)) + 0.6 * np.random.default_rng(seed).standard_normal((n, SIZE))


def want(x, groups, least, k):
    """Pairs of which one is among the k most similar ones of the other in its group."""
    u = packed(x).astype(np.float64) / vectors.SCALE
    s = u @ u.T
    out = {}
    for i in range(len(x)):
        at = [j for j in range(len(x)) if j != i and groups[j] == groups[i] and s[i, j] >= least]
        out |= {(min(i, j), max(i, j)): s[i, j] for j in sorted(at, key=lambda j: -s[i, j])[:k]}
    return out


def test_parts_of_a_group_give_its_best_rows(spark, monkeypatch):
    """Groups of 3, 30 and 260 vectors in blocks of 40: the last one in seven parts."""
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    x = drawn(293)
    groups = [0] * 3 + [1] * 30 + [2] * 260
    members = spark.createDataFrame(list(zip(groups, range(len(x)))), "grp bigint, rid bigint")
    for least, k in ((-1.0, 4), (0.8, 3)):
        found = neighbours.exact_pairs(members, stored(spark, x), least, k)
        got = {(r.a, r.b): r.similarity for r in found.collect()}
        expected = want(x, groups, least, k)
        assert set(got) == set(expected) and all(abs(got[p] - s) < 1e-6 for p, s in expected.items())
        assert found.count() <= len(x) * k  # not k rows of each part


def test_no_vector_is_its_own_neighbour(spark):
    """In a group of fewer than k vectors."""
    members = spark.createDataFrame([(0, 0), (0, 1)], "grp bigint, rid bigint")
    assert {(r.a, r.b) for r in neighbours.exact_pairs(members, stored(spark, drawn(2)), -1.0, 5).collect()} == {(0, 1)}


def test_shares_of_groups():
    counts = [(1, 10), (4, 20), (5, 15), (7, 130), (9, 40), (12, 1)]
    assert list(vectors.shares(counts, 40)) == [(1, 4, 1), (5, 5, 1), (7, 7, 4), (9, 9, 1), (12, 12, 1)]
    assert list(vectors.shares([], 40)) == []


def test_copied_vectors_are_deleted_if_owned(spark, monkeypatch):
    """The same rows; the table is there as long as it is read, and left to others that read it."""
    monkeypatch.setattr(vectors, "BROADCAST_ROWS", 0)
    x = np.concatenate([drawn(60), drawn(60)[:20]])
    rows = {}
    for own in (False, True):
        v, h = usable(spark, x)
        folder = os.path.dirname(v.inputFiles()[0]).split(":", 1)[-1].replace("//", "/")
        assert os.path.exists(folder)
        rows[own] = sorted((r.key, r.neighbour, r["rank"]) for r in neighbours.neighbours(v, h, size=SIZE, own=own).collect())
        assert os.path.exists(folder) != own
    assert rows[True] == rows[False] and len(rows[True]) > 40
