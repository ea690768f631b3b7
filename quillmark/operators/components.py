"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.session import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (the smallest node of the component) for every node of an edge.

    Alternates large-star and small-star steps until the edges no longer change,
    which takes a number of rounds logarithmic in practice. Each round is two
    shuffles on the node; groups are only reduced by ``min``, so a hub of any
    degree is handled by partial aggregation and a join. Self-loops and repeated
    edges are allowed, rows with a null end are left out, and an empty table
    gives an empty result. Rounds are logarithmic in the longest path; should
    ``most_rounds`` not be enough, that is an error.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    nodes = cut(e.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    e = e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # large star: neighbours greater than the node go to its least neighbour
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: the node and its smaller neighbours go to the least of them
        small = large.join(low2, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        e = cut(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct())
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components not settled after {most_rounds} rounds; allow more")
    roots = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes.node == roots.u, "left").select("node", F.coalesce("component", "node").alias("component"))


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r.n, r.h
