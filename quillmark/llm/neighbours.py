"""Problem 1: the most similar vectors of every vector.

Method: multi-probe p-stable hashing. A vector is kept in one bucket of each of
several tables; it looks into that bucket and into perturbed ones, in the order
in which they are expected to succeed. Candidates are thinned by a bit sketch where
they meet, merged and reranked by the similarity of the vectors. Vectors that meet
in crowded buckets are compared exactly instead.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.clusters import Limits, grow
from quillmark.llm.vectors import BLOCK, BROADCAST_ROWS, matrix, passes, representatives, share, shares, slices, small, unpacked
from quillmark.operators.components import connected_components
from quillmark.session import discard, materialise, ship_package

BITS = 768
#: Vectors times tables up to which the buckets of several tables are joined at once.
TABLE_ROWS = 8_000


@dataclass(frozen=True)
class Hashing:
    """Parameters of the tables; the recall they give is measured in the tests and the README."""

    tables: int = 8
    functions: int = 20
    width: float = 2.3
    probes: int = 10
    seed: int = 17
    #: The vectors that meet in a bucket with more vectors are compared exactly.
    hot: int = 1000


def perturbations(functions: int, probes: int) -> list[tuple[int, ...]]:
    """The ``probes`` best sets of ranks to perturb.

    Ranks 0.. number the 2 * ``functions`` borders of a bucket by distance; a set
    must not hold both borders of one function. Scores are the expected squared
    distances of the ranks.
    """
    m = functions
    scale = 4 * (m + 1) * (m + 2)
    near = [(j + 1) * (j + 2) / scale for j in range(m)]
    far = [1 - 2 * (2 * m - j) / (2 * (m + 1)) + (2 * m - j) * (2 * m - j + 1) / scale for j in range(m, 2 * m)]
    cost = near + far
    heap = [(cost[0], (0,))]
    out: list[tuple[int, ...]] = []
    while heap and len(out) < probes:
        s, ranks = heapq.heappop(heap)
        if len({min(r, 2 * m - 1 - r) for r in ranks}) == len(ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
            heapq.heappush(heap, (s + cost[last + 1], (*ranks, last + 1)))
    return out


class Tables:
    """The hash functions, drawn from the seed."""

    def __init__(self, h: Hashing, size: int) -> None:
        rng = np.random.default_rng([h.seed, 0])
        self.h = h
        self.tables = h.tables
        self.width = h.width
        m = h.functions
        self.a = rng.standard_normal((size, self.tables * m), dtype=np.float32)
        self.b = rng.uniform(0, self.width, self.tables * m).astype(np.float32)
        self.r = rng.integers(1, 2**62, (self.tables, m), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        self.sets = perturbations(m, h.probes)

    def keys(self, x: np.ndarray, salt: np.ndarray, probe: bool, some: range) -> np.ndarray:
        """Bucket numbers of some tables, shape (rows, tables, 1 or 1 + probes); the own bucket of a table comes first."""
        m = self.h.functions
        at = slice(some.start * m, some.stop * m)
        f = ((x @ self.a[:, at] + self.b[at]) / self.width).reshape(len(x), len(some), m)
        r = self.r[some.start : some.stop]
        whole = np.floor(f)
        with np.errstate(over="ignore"):
            base = (whole.astype(np.int64).astype(np.uint64) * r).sum(2) + salt[:, None]
            if not probe:
                return base.view(np.int64)[:, :, None]
            part = f - whole
            out = np.empty((len(x), len(some), 1 + len(self.sets)), np.uint64)
            out[:, :, 0] = base
            zero = np.uint64(0)
            for t in range(len(some)):
                border = np.concatenate([part[:, t], 1 - part[:, t]], 1)
                order = np.argsort(border, 1)
                step = np.concatenate([zero - r[t], r[t]])[order]
                for k, ranks in enumerate(self.sets):
                    out[:, t, k + 1] = base[:, t] + step[:, list(ranks)].sum(1)
        return out.view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1)))


def _salts(models: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(m.encode()) * 0x9E3779B97F4A7C15 % 2**64 for m in models], np.uint64)


def keyed(reps: DataFrame, h: Hashing, size: int, probe: bool) -> DataFrame:
    """(key, rid) of every bucket a vector is kept in, or looks into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(h, size)
        for whole in batches:
            for b in slices(whole):
                k = t.keys(matrix(b.column(2)), _salts(b.column(1).to_pylist()), probe, range(h.tables))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(k.reshape(b.num_rows, -1))], names=["rid", "keys"])

    return reps.select("rid", "model", "vec").mapInArrow(run, "rid bigint, keys array<bigint>").select(F.explode("keys").alias("key"), "rid")


def hashed(reps: DataFrame, h: Hashing, size: int, some: range) -> DataFrame:
    """``rid``, the signs of ``BITS`` random projections as longs ``s0``.., and of some tables the buckets a vector is ``kept`` in and those it looks into (``look``)."""
    n = BITS // 64
    signs = [f"s{i}" for i in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(h, size)
        a = np.random.default_rng([h.seed, 99]).standard_normal((size, BITS), dtype=np.float32)
        for whole in batches:
            for b in slices(whole):
                x = matrix(b.column(2))
                bits = np.packbits(x @ a > 0, axis=1).view(np.int64)
                k = t.keys(x, _salts(b.column(1).to_pylist()), True, some)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(n)), _lists(k[:, :, 0]), _lists(k.reshape(len(x), -1))], names=["rid", *signs, "kept", "look"])

    return reps.select("rid", "model", "vec").mapInArrow(run, "rid bigint, " + "".join(f"{c} bigint, " for c in signs) + "kept array<bigint>, look array<bigint>")


def near_pairs(reps: DataFrame, h: Hashing, size: int, least: float) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (a < b) that meet in a bucket that is not hot and whose sketches are near, and ``(grp, rid)`` of the vectors that meet in hot ones.

    The sketches travel to the buckets, one table after the other (of few vectors
    several at once), so that pairs that only meet are dropped where they meet: their
    number grows with the density of the vectors, that of what travels doesn't.

    Hot buckets that share a vector are one group, so two vectors that meet in
    several of them are compared once. A group holds the vectors kept in its
    buckets and those that look into them. None where no bucket is hot.
    """
    signs = [f"s{i}" for i in range(BITS // 64)]
    once = max(1, min(h.tables, TABLE_ROWS // max(1, reps.count())))
    hot = materialise(keyed(reps, h, size, False).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > h.hot).select("key"), "hot-buckets")
    some = not hot.isEmpty()
    hint = small(hot) if some else None
    cold = lambda df: df if hint is None else df.join(hint, "key", "left_anti")
    apart = sum((F.bit_count(F.col(f"x.{c}").bitwiseXOR(F.col(f"y.{c}"))) for c in signs), F.lit(0))
    x, y = F.col("x.rid"), F.col("y.rid")
    found = []
    for t in range(0, h.tables, once):
        stored = materialise(hashed(reps, h, size, range(t, min(t + once, h.tables))), "hashes")
        side = lambda c: cold(stored.select(F.explode(c).alias("key"), "rid", *signs))
        met = side("look").alias("x").join(side("kept").alias("y"), "key").filter((x != y) & (apart <= bit_limit(least)))
        found.append(materialise(met.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct(), "near-pairs"))
        discard(stored)
    near = found[0]
    if len(found) > 1:
        near = materialise(reduce(DataFrame.unionAll, found).distinct(), "near-pairs")
        discard(*found)
    if not some:
        return near, None
    held = materialise(keyed(reps, h, size, False).join(hint, "key", "left_semi"), "hot-kept")
    shared = held.join(held.groupBy("rid").agg(F.min("key").alias("a")), "rid").select("a", F.col("key").alias("b")).distinct()
    group = small(materialise(connected_components(shared).select(F.col("node").alias("key"), F.col("component").alias("grp")), "hot-groups"))
    return near, materialise(keyed(reps, h, size, True).join(group, "key").select("grp", "rid").distinct(), "hot-members")


def best(x: np.ndarray, own: np.ndarray, packed: np.ndarray, rid: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of ``x`` its ``k`` most similar rows of ``packed``, of at least ``least``, ties included; never itself. ``rid`` is sorted.

    Products are float32, so what is closer than ``spare`` to the last one stays too.
    """
    spare = 1e-5
    floor = np.full(len(x), least, np.float32)
    p = q = np.zeros(0, np.int64)
    v = np.zeros(0, np.float32)
    for i in range(0, len(rid), 4096):
        to = rid[i : i + 4096]
        s = x @ unpacked(packed[i : i + 4096]).T
        me = np.minimum(np.searchsorted(to, own), len(to) - 1)
        same = np.flatnonzero(to[me] == own)
        s[same, me[same]] = -2
        hit = s >= floor[:, None] - spare
        many = np.flatnonzero(hit.sum(1) > k)
        if len(many):
            floor[many] = np.maximum(floor[many], np.partition(s[many], -k, 1)[:, -k])
            hit[many] = s[many] >= floor[many, None] - spare
        r, c = np.nonzero(hit)
        if not len(r):
            continue
        p, q, v = np.append(p, r), np.append(q, c + i), np.append(v, s[r, c])
        order = np.lexsort((-v, p))
        p, q, v = p[order], q[order], v[order]
        row, start, n = np.unique(p, return_index=True, return_counts=True)
        full = n >= k
        floor[row[full]] = np.maximum(floor[row[full]], v[start[full] + k - 1])
        stay = v >= floor[p] - spare
        p, q, v = p[stay], q[stay], v[stay]
    return p, q


def best_of_each(found: list[DataFrame], k: int) -> DataFrame:
    """Of the pairs (rid, other, similarity) the ``k`` most similar ones of each ``rid``, ties included; the tables they come from are deleted."""
    w = Window.partitionBy("rid").orderBy(F.desc("similarity"))
    out = materialise(reduce(DataFrame.unionAll, found).withColumn("n", F.rank().over(w)).filter(F.col("n") <= k).drop("n"), "hot-pairs")
    discard(*found)
    return out


def exact_pairs(members: DataFrame, vectors: DataFrame, least: float, k: int) -> DataFrame:
    """Pairs (a < b, similarity) of at least ``least`` within the groups: of each vector its ``k`` most similar ones, ties included.

    Every vector is compared with all others of its group by matrix products, so
    nothing is missed and the work is quadratic in a group; of the similarities
    only the best of each row leave a task. Groups are taken in turn. One that is
    larger than a broadcast is compared part by part, and what the parts give is
    cut to the best of each row on the way, so that it does not grow with them.
    """
    rows = materialise(vectors.join(small(members), "rid").select("grp", "rid", "vec").sortWithinPartitions("grp"), "hot-vectors")
    counts = sorted((r.grp, r.n) for r in rows.groupBy("grp").agg(F.count("*").alias("n")).collect())
    size = dict(counts)
    out = [rows.sparkSession.createDataFrame([], "rid bigint, other bigint, similarity double")]
    for first, last, parts in shares(counts, BLOCK):
        mine = rows.filter(F.col("grp").between(first, last))
        found: list[DataFrame] = []
        for part in range(parts):
            shared = share(mine if parts == 1 else mine.filter(F.pmod(F.xxhash64("rid"), F.lit(parts)) == part), "grp")

            def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
                other, packed = shared.value
                group, rid = other["grp"], other["rid"]
                for whole in batches:
                    for b in slices(whole):
                        g, own, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))
                        for c in np.unique(g):
                            at = np.flatnonzero(g == c)
                            i, j = np.searchsorted(group, c, "left"), np.searchsorted(group, c, "right")
                            p, q = best(x[at], own[at], packed[i:j], rid[i:j], least, k)
                            for n in range(0, len(p), 8192):
                                u, v = at[p[n : n + 8192]], i + q[n : n + 8192]
                                exact = np.einsum("ij,ij->i", x[u].astype(np.float64), unpacked(packed[v]).astype(np.float64))
                                yield pa.RecordBatch.from_arrays([pa.array(own[u]), pa.array(rid[v]), pa.array(np.minimum(exact, 1.0))], names=["rid", "other", "similarity"]).filter(pa.array(exact >= least))

            found.append(materialise(mine.mapInArrow(run, "rid bigint, other bigint, similarity double"), "hot-pairs"))
            shared.destroy()
            if len(found) > 1 and (part == parts - 1 or sum(f.count() for f in found) > 3 * k * size[first]):
                found = [best_of_each(found, k)]
        out += found
    discard(rows)
    return reduce(DataFrame.unionAll, out).select(F.least("rid", "other").alias("a"), F.greatest("rid", "other").alias("b"), "similarity")


def bit_limit(similarity: float) -> int:
    """Differing bits of a pair of that similarity, with three standard deviations to spare."""
    p = math.acos(max(-1.0, min(1.0, similarity))) / math.pi
    return min(BITS, math.ceil(BITS * p + 3 * math.sqrt(BITS * p * (1 - p))))


def verified(near: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """Pairs (a < b, similarity) of at least ``least`` among the pairs of ``near``.

    Either both vectors travel to each pair, about as many pairs at a time as there
    are vectors, or every vector is brought its list once and compared with blocks
    of all vectors: whichever takes fewer rounds. The first grows with the pairs,
    the second with the square of the vectors; neither fills the disk with pairs.
    """
    n = vectors.count()
    rounds = max(1, -(-near.count() // max(n, BLOCK)))
    return verified_by_blocks(near, vectors, least) if -(-n // BLOCK) <= rounds else verified_by_pairs(near, vectors, least, rounds)


def verified_by_pairs(near: DataFrame, vectors: DataFrame, least: float, rounds: int) -> DataFrame:
    """``verified``, a share of the pairs at a time with both vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole):
                s = np.einsum("ij,ij->i", matrix(b.column(2)).astype(np.float64), matrix(b.column(3)).astype(np.float64))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.minimum(s, 1.0))], names=["a", "b", "similarity"]).filter(pa.array(s >= least))

    found = []
    for i in range(rounds):
        some = near.filter(F.pmod(F.xxhash64("a"), F.lit(rounds)) == i)
        ids = materialise(some.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "near-ids")
        x = vectors.join(F.broadcast(ids), "rid", "left_semi") if ids.count() <= BROADCAST_ROWS else vectors
        one = some.join(x.select(F.col("rid").alias("a"), F.col("vec").alias("va")), "a")
        both = one.join(x.select(F.col("rid").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")
        found.append(materialise(both.mapInArrow(run, "a bigint, b bigint, similarity double"), "verified-pairs"))
    return reduce(DataFrame.unionAll, found)


def verified_by_blocks(near: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """``verified``, a vector with its list against one block of all vectors after the other."""
    lists = materialise(near.groupBy("a").agg(F.collect_set("b").alias("bs")), "near-lists")
    if (lists.agg(F.sum(F.size("bs"))).first()[0] or 0) <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    rows = materialise(vectors.join(lists.withColumnRenamed("a", "rid"), "rid").select("rid", "vec", "bs"), "near-vectors")
    out = None
    for shared in passes(vectors):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            other, packed = shared.value
            rid = other["rid"]
            for whole in batches:
                for b in slices(whole):
                    own, x, bs = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2)
                    u, to = np.repeat(np.arange(len(own)), bs.value_lengths().to_numpy()), bs.flatten().to_numpy()
                    v = np.searchsorted(rid, to)
                    here = np.flatnonzero((v < len(rid)) & (rid[np.minimum(v, len(rid) - 1)] == to)) if len(rid) else np.zeros(0, np.int64)
                    for n in range(0, len(here), 8192):
                        i, j = u[here[n : n + 8192]], v[here[n : n + 8192]]
                        s = np.einsum("ij,ij->i", x[i].astype(np.float64), unpacked(packed[j]).astype(np.float64))
                        yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(rid[j]), pa.array(np.minimum(s, 1.0))], names=["a", "b", "similarity"]).filter(pa.array(s >= least))

        found = materialise(rows.mapInArrow(run, "a bigint, b bigint, similarity double"), "verified-pairs")
        out = found if out is None else out.unionAll(found)
    discard(rows)
    assert out is not None
    return out


def similar_pairs(reps: DataFrame, h: Hashing, size: int, least: float, k: int) -> DataFrame:
    """Pairs (a < b, similarity) of representatives of at least ``least``, among the candidates; of a hot group the best ``k`` of each row."""
    near, hot = near_pairs(reps, h, size, least)
    pairs = verified(near, reps.select("rid", "vec"), least)
    if hot is None:
        return pairs
    return pairs.unionAll(exact_pairs(hot, reps.select("rid", "vec"), least, k)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def leaf_pairs(reps: DataFrame, size: int, k: int) -> DataFrame:
    """Pairs (a < b, similarity): of each representative its ``k`` most similar ones in its leaf of a bisecting k-means tree, compared exactly.

    Below the floor of the tables hashing can't tell near from far without looking
    at nearly everything; the leaves hold what lies in one direction.
    """
    spark = reps.sparkSession
    limits = Limits()
    models = sorted(r[0] for r in reps.select("model").distinct().collect())
    tree = grow(reps, models, size, limits)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = shared.value.leaf_of(np.array(b.column(1).to_pylist()), matrix(b.column(2))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(leaf, np.int64)), b.column(0)], names=["grp", "rid"])

    members = materialise(reps.select("rid", "model", "vec").mapInArrow(place, "grp bigint, rid bigint"), "leaf-members")
    return exact_pairs(members, reps.select("rid", "vec"), -1.0, k)


def neighbours(vectors: DataFrame, heads: DataFrame, *, k: int = 10, least: float = 0.8, size: int = 384, hashing: Hashing | None = None, fill: bool = False, own: bool = False) -> DataFrame:
    """For each post its ``k`` most similar posts of the same model: ``key``, ``neighbour``, ``similarity``, ``rank``.

    Neighbours of similarity ``least`` or more are searched for by hashing; that
    floor is what the tables are tuned to. With ``fill`` the lists are filled with
    less similar ones by ``leaf_pairs``; without, posts that have no neighbour above
    the floor have no row. Ties in similarity go to the smaller key. Posts with the
    same vector are hashed once; each of them gets its own list, made from the
    first k + 1 members of each group, which is exact for the top k. With ``own``
    nothing else reads ``vectors``, so the table is deleted as soon as it was copied
    and the copy when the pairs are known.
    """
    ship_package(vectors.sparkSession)
    h = hashing or Hashing()
    reps, members = representatives(vectors, heads)
    if own and not set(reps.inputFiles()) & set(vectors.inputFiles()):
        discard(vectors)
    pairs = similar_pairs(reps, h, size, least, k + 1)
    if fill:
        pairs = pairs.unionAll(leaf_pairs(reps, size, k + 1)).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    pairs = materialise(pairs, "similar-pairs")
    if own:
        discard(reps)
    by_key = Window.partitionBy("rep").orderBy("key")
    first = members.withColumn("n", F.row_number().over(by_key)).filter(F.col("n") <= k + 1).select("rep", "key")
    way = pairs.select(F.col("a").alias("q"), F.col("b").alias("rep"), "similarity").unionAll(pairs.select(F.col("b").alias("q"), F.col("a").alias("rep"), "similarity"))
    repeated = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select("rep")
    own = first.join(repeated, "rep", "left_semi").select(F.col("rep").alias("q"), F.col("key").alias("neighbour"), F.lit(1.0).alias("similarity"))
    near = way.join(first, "rep").select("q", F.col("key").alias("neighbour"), "similarity").unionAll(own)
    best = Window.partitionBy("q").orderBy(F.desc("similarity"), "neighbour")
    lists = near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).select("q", "neighbour", "similarity")
    each = members.select(F.col("rep").alias("q"), "key").join(lists, "q").filter("key <> neighbour")
    rank = Window.partitionBy("key").orderBy(F.desc("similarity"), "neighbour")
    return each.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= k).select("key", "neighbour", "similarity", "rank")
