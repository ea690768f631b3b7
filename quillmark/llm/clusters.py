"""Problem 6: groups of mutually similar vectors.

Method: bisecting k-means. The nodes of largest dispersion are split in two, again
and again, by passes over all vectors, until the leaves are compact; leaves whose
typical members are linked are one set. Posts are then compared with all members
of the other leaves near them, which joins sets and posts the tree left apart, and
posts that no centre explains are compared exactly with one another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.vectors import SCALE, matrix, only, passes, slices, small, unpacked
from quillmark.operators.components import connected_components
from quillmark.session import materialise, ship_package


@dataclass(frozen=True)
class Limits:
    """Parameters of the tree."""

    link: float = 0.35  # similarity of a link
    # A member this near to the centre is explained by it: the root of ``link``, which members of one
    # cluster reach where their mean similarity is a link; two clusters under one centre stay below it.
    core: float = 0.592
    compact: float = 0.8  # share of explained members at which a leaf is compact
    rounds: int = 24  # levels of the tree
    lloyd: int = 3  # passes that move the two centres of a split
    seeds: int = 24  # rows of a node that only start the two centres
    at_once: int = 256  # nodes of largest dispersion that are split in one round
    typical: int = 8  # centre-nearest members kept of a leaf
    most_leaves: int = 4096  # size of the tree; where it is reached leaves are larger, nothing is left out
    # A post is compared with the members of all leaves whose centre it is this near to. Linked to a member,
    # it is expected at ``link`` times that member's nearness, about .2; unlike vectors are at 0 +- .05.
    near_loose: float = 0.08  # for posts of no set
    near_set: float = 0.15  # for members of other sets
    members_at_once: int = 16_384  # larger leaves are compared in parts
    posts_at_once: int = 65_536


@dataclass
class Node:
    model: str
    centre: np.ndarray
    count: int = 0
    explained: int = 0
    left: int = -1
    right: int = -1
    final: bool = False


@dataclass
class Tree:
    """The tree on the driver: ``most_leaves`` centres at most, whatever the data."""

    nodes: list[Node] = field(default_factory=list)
    roots: dict[str, int] = field(default_factory=dict)

    def leaf_of(self, models: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Leaf of every row, by descending to the nearer child."""
        at = np.array([self.roots.get(m, -1) for m in models])
        active = np.unique(at[at >= 0])
        while len(active):
            nxt = []
            for n in active:
                node = self.nodes[n]
                if node.left < 0:
                    continue
                rows = np.flatnonzero(at == n)
                c = np.stack([self.nodes[node.left].centre, self.nodes[node.right].centre])
                side = (x[rows] @ c.T).argmax(1)
                at[rows] = np.where(side == 0, node.left, node.right)
                nxt += [node.left, node.right]
            active = np.array(nxt)
        return at


def _unit(v: np.ndarray) -> np.ndarray:
    return v / (np.linalg.norm(v) or 1.0)


def _pass(rows: DataFrame, tree: Tree, seeds: int, limits: Limits) -> dict[int, dict]:
    """One pass over all vectors: count, sum, explained rows and ``seeds`` rows of each leaf.

    Rows the centre does not explain are taken first, in order of a hash.
    Each task sends one row for each leaf it met; these are merged by leaf before
    they reach the driver.
    """
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(tree)
    schema = "leaf int, n bigint, explained bigint, total binary, sample binary, marks binary"
    names = ["leaf", "n", "explained", "total", "sample", "marks"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    core = limits.core
    top = np.uint64(1 << 63)

    def emit(acc: dict[int, list]) -> pa.RecordBatch:
        cols = list(zip(*[(k, v[0], v[1], v[2].tobytes(), np.rint(v[3] * SCALE).astype(np.int16).tobytes(), v[4].tobytes()) for k, v in acc.items()])) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], names=names)

    def merge(acc: dict[int, list], k: int, n: int, explained: int, total: np.ndarray, sample: np.ndarray, marks: np.ndarray) -> None:
        old = acc.get(k)
        if old:
            n, explained, total = old[0] + n, old[1] + explained, old[2] + total
            sample, marks = np.concatenate([old[3], sample]), np.concatenate([old[4], marks])
        first = np.argsort(marks, kind="stable")[:seeds]
        acc[k] = [n, explained, total, sample[first], marks[first]]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        acc: dict[int, list] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2))
            leaf = t.leaf_of(np.array(b.column(1).to_pylist()), x)
            marks = (b.column(0).to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(1)
            for k in np.unique(leaf[leaf >= 0]):
                if t.nodes[k].final:
                    continue
                own = np.flatnonzero(leaf == k)
                y = x[own]
                known = y @ t.nodes[k].centre >= core
                near = int(known.sum())
                marks[own[known]] |= top
                pick = own[np.argsort(marks[own], kind="stable")[:seeds]]
                merge(acc, int(k), len(own), near, y.sum(0, dtype=np.float64), x[pick].astype(np.float64), marks[pick])
        yield emit(acc)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, list] = {}
        for b in batches:
            for r in b.to_pylist():
                total = np.frombuffer(r["total"], np.float64)
                sample = np.frombuffer(r["sample"], np.int16).reshape(-1, len(total)) / SCALE
                merge(acc, r["leaf"], r["n"], r["explained"], total, sample, np.frombuffer(r["marks"], np.uint64))
        yield emit(acc)

    parts = rows.mapInArrow(scan, schema)
    out = {}
    for r in parts.repartition(8, "leaf").mapInArrow(reduce, schema).collect():
        total = np.frombuffer(r.total, np.float64)
        out[r.leaf] = {"n": r.n, "explained": r.explained, "total": total, "sample": np.frombuffer(r.sample, np.int16).reshape(-1, len(total)) / SCALE}
    shared.unpersist()
    return out


def _start(sample: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Two centres for a split: the best of a few two-means runs over the node's seed rows."""
    best, score = None, -np.inf
    for _ in range(6):
        c = sample[rng.choice(len(sample), 2, replace=False)].astype(np.float64)
        for _ in range(8):
            side = (sample @ c.T).argmax(1)
            for i in (0, 1):
                if (side == i).any():
                    c[i] = _unit(sample[side == i].sum(0))
        s = float((sample @ c.T).max(1).sum())
        if s > score:
            best, score = (c[0], c[1]), s
    assert best is not None
    return best


def grow(rows: DataFrame, models: list[str], size: int, limits: Limits, seed: int = 5) -> Tree:
    """Split until every leaf is compact, too small for a cluster, or the tree is full.

    ``rows`` holds rid, model and vec. A node's dispersion is its number of rows
    times (1 - squared length of their mean).
    """
    rng = np.random.default_rng(seed)
    tree = Tree()
    for m in models:
        tree.roots[m] = len(tree.nodes)
        tree.nodes.append(Node(m, np.zeros(size)))
    for _ in range(limits.rounds):
        stats = _pass(rows, tree, limits.seeds, limits)
        split = []
        for k, s in stats.items():
            node = tree.nodes[k]
            centre = _unit(s["total"])
            node.count, node.explained = s["n"], s["explained"]
            length = float(np.linalg.norm(s["total"])) / max(1, s["n"])
            moved = float(centre @ node.centre) < 0.98
            node.centre = centre
            # Compact: the centre explains its members, and those it does not explain are unlike each other.
            odd = s["sample"][: max(0, min(len(s["sample"]), s["n"] - s["explained"]))]
            group = _linked_group(odd, limits.link)
            hidden = len(group) >= max(3, 0.15 * len(odd))
            if s["n"] < 5 or not moved and not hidden and s["explained"] >= limits.compact * s["n"]:
                node.final = True
            elif len(s["sample"]) >= 2:
                start = (centre, _unit(group.sum(0))) if hidden and s["explained"] >= 0.5 * s["n"] else None
                split.append((s["n"] * (1 - length * length), k, s["sample"], start))
        split.sort(key=lambda z: (-z[0], z[1]))
        room = max(0, limits.most_leaves - sum(n.left < 0 for n in tree.nodes))
        todo = split[: min(limits.at_once, room)]
        # Rows that are all unlike each other have no direction in common: such a node stays a leaf.
        todo = [z for z in todo if not _diffuse(tree.nodes[z[1]], z[2], limits)]
        for z in split:
            if z[1] not in {t[1] for t in todo} and _diffuse(tree.nodes[z[1]], z[2], limits):
                tree.nodes[z[1]].final = True
        if not todo:
            if all(tree.nodes[k].final for k in stats):
                break
            continue
        for _, k, sample, start in todo:
            a, b = start or _start(sample, rng)
            node = tree.nodes[k]
            node.left, node.right = len(tree.nodes), len(tree.nodes) + 1
            tree.nodes += [Node(node.model, a), Node(node.model, b)]
        for _ in range(limits.lloyd):
            for k, s in _pass(rows, tree, 0, limits).items():
                tree.nodes[k].centre = _unit(s["total"])
    return tree


def _linked_group(sample: np.ndarray, link: float) -> np.ndarray:
    """The rows linked to the one with the most links, itself included."""
    if not len(sample):
        return sample
    s = sample @ sample.T >= link
    return sample[s[s.sum(1).argmax()]]


def _diffuse(node: Node, sample: np.ndarray, limits: Limits) -> bool:
    """No two of the node's seed rows are linked and the centre explains nobody."""
    s = sample @ sample.T
    linked = (s >= limits.link).sum() - len(sample)
    return node.explained == 0 and linked == 0 and len(sample) >= limits.seeds


def clusters(vectors: DataFrame, heads: DataFrame, *, size: int = 384, least_size: int = 5, limits: Limits | None = None) -> DataFrame:
    """Members of clusters: ``key``, ``model``, ``cluster`` (its smallest key), ``size``, ``similarity`` to the centre, ``extra``.

    Posts linked, at a similarity of ``limits.link`` or more, to a centre-nearest
    member of a leaf make a first set with it. Every post is then compared with all
    members of the leaves near it that hold other sets (``near_links``), and posts
    that no centre explains with one another (``odd_links``); clusters are the sets
    joined by these links, those of ``least_size`` or more count. Only a link of an
    explained member to a post that is unlike its centre can be missed; the README
    gives the measured recall. Models are never mixed. An empty table gives no rows.
    """
    limits = limits or Limits()
    spark = vectors.sparkSession
    ship_package(spark)
    models = sorted(r[0] for r in heads.select("model").distinct().collect())
    rows = only(vectors, heads)
    tree = grow(rows, models, size, limits)
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        centres = np.stack([n.centre for n in t.nodes])
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(2))
                leaf = t.leaf_of(np.array(b.column(1).to_pylist()), x)
                near = np.einsum("ij,ij->i", x, centres[leaf])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(leaf.astype(np.int32)), pa.array(near.astype(np.float64))], names=["rid", "leaf", "near"])

    placed = rows.mapInArrow(place, "rid bigint, leaf int, near double") if models else spark.createDataFrame([], "rid bigint, leaf int, near double")
    # Typical members of each leaf: at most most_leaves * typical vectors.
    by_leaf = Window.partitionBy("leaf").orderBy(F.desc("near"), "rid")
    top = placed.withColumn("n", F.row_number().over(by_leaf)).filter(F.col("n") <= limits.typical)
    reps = rows.join(small(materialise(top.select("rid", "leaf"), "typical")), "rid").select("leaf", "rid", "model", "vec").collect()
    reps.sort(key=lambda r: (r.leaf, r.rid))
    rep_leaf = np.array([r.leaf for r in reps], int)
    rep_model = np.array([r.model for r in reps])
    rep_x = matrix(pa.array([r.vec for r in reps], pa.binary()))
    sets = linked_sets(rep_x, rep_model, limits.link)
    table = spark.sparkContext.broadcast((rep_leaf, rep_model, rep_x, sets))
    link = limits.link

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Set of each row by a link to a typical member: of its own leaf first, then of any."""
        own_leaf, model, x_rep, group = table.value
        t = shared.value
        centres = np.stack([n.centre for n in t.nodes])
        by = {k: np.flatnonzero(own_leaf == k) for k in np.unique(own_leaf)}
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column(2))
            models_here = np.array(b.column(1).to_pylist())
            leaf = t.leaf_of(models_here, x)
            near = np.einsum("ij,ij->i", x, centres[leaf]).astype(np.float64)
            out = np.full(len(x), -1, np.int64)
            for k in np.unique(leaf):
                at, r = np.flatnonzero(leaf == k), by.get(k)
                if r is not None:
                    s = x[at] @ x_rep[r].T
                    hit = s.max(1) >= link
                    out[at[hit]] = group[r[s.argmax(1)]][hit]
            rest = np.flatnonzero(out < 0)
            for i in range(0, len(rest), 1024):
                part = rest[i : i + 1024]
                s = x[part] @ x_rep.T
                s[models_here[part][:, None] != model[None, :]] = -1
                hit = s.max(1) >= link
                out[part[hit]] = group[s.argmax(1)][hit]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array(near), b.column(1), b.column(2), pa.array(leaf.astype(np.int32))], names=["rid", "grp", "near", "model", "vec", "leaf"])

    schema = "rid bigint, grp bigint, near double, model string, vec binary, leaf int"
    attached = materialise(rows.mapInArrow(attach, schema), "attached") if reps else spark.createDataFrame([], schema)
    near = materialise(near_links(attached, tree, limits), "near-links")
    links = near.unionAll(odd_links(attached, near, limits))
    comp = small(materialise(connected_components(links), "components"))
    own = attached.select("rid", F.when(F.col("grp") < 0, F.col("rid")).otherwise(-1 - F.col("grp")).alias("node"))
    of = own.join(comp, "node", "left").select("rid", F.coalesce("component", "node").alias("grp"))
    sized = of.join(heads.select("rid", "key", "model", "extra"), "rid").join(attached.select("rid", "near"), "rid")
    info = sized.groupBy("grp").agg(F.count("*").alias("size"), F.min("key").alias("cluster")).filter(F.col("size") >= least_size)
    return sized.join(info, "grp").select("key", "model", "cluster", "size", F.col("near").alias("similarity"), "extra")


def linked_sets(x: np.ndarray, model: np.ndarray, link: float) -> np.ndarray:
    """For each row the smallest row of its set: rows of a model joined by links, directly or through others."""
    root = np.arange(len(x))
    for i in range(0, len(x), 512):
        linked = x[i : i + 512] @ x.T >= link
        linked &= model[i : i + 512, None] == model[None, :]
        for own, hit in enumerate(linked, i):
            met = np.unique(np.append(root[hit], root[own]))
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    return root


def _node(b: pa.RecordBatch) -> np.ndarray:
    """-1 - grp for a row of a set, rid for a row of its own; of columns rid and grp."""
    g = b.column("grp").to_numpy()
    return np.where(g < 0, b.column("rid").to_numpy(), -1 - g)


def near_links(attached: DataFrame, tree: Tree, limits: Limits) -> DataFrame:
    """Links (a, b) of posts to members of other sets in the leaves near them.

    A post goes to every leaf of its model whose centre is near enough and that
    holds members of another set; there it is compared with all these members.
    Leaves and their visitors are cut to parts of bounded size, each pair of parts
    is one task's work. A node is -1 - grp for a set and rid for a post of no set.
    """
    spark = attached.sparkSession
    members = attached.filter("grp >= 0")
    # One row for each leaf: whether it holds one set, and how many rows.
    held = {r.leaf: (r.lo if r.lo == r.hi else -1) for r in members.groupBy("leaf").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).collect()}
    leaves = np.array(sorted(held), np.int64)
    empty = spark.createDataFrame([], "a bigint, b bigint")
    if not len(leaves):
        return empty
    shared = spark.sparkContext.broadcast((leaves, np.array([held[k] for k in leaves.tolist()]), np.array([tree.nodes[k].model for k in leaves]), np.stack([tree.nodes[k].centre for k in leaves]).astype(np.float32)))
    loose, strict = limits.near_loose, limits.near_set

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, only_set, model, centres = shared.value
        for whole in batches:
            for b in slices(whole):
                x = matrix(b.column("vec"))
                g = b.column("grp").to_numpy()
                go = x @ centres.T >= np.where(g < 0, loose, strict)[:, None]
                go &= np.array(b.column("model").to_pylist())[:, None] == model[None, :]
                go &= (g[:, None] != only_set[None, :]) | (only_set < 0)[None, :]
                row, leaf = np.nonzero(go)
                for i in range(0, len(row), 4096):
                    r = pa.array(row[i : i + 4096])
                    yield pa.RecordBatch.from_arrays([pa.array(of[leaf[i : i + 4096]].astype(np.int32)), b.column("rid").take(r), b.column("grp").take(r), b.column("vec").take(r)], names=["leaf", "rid", "grp", "vec"])

    cols = attached.select("rid", "grp", "model", "vec")
    visits = materialise(cols.mapInArrow(visit, "leaf int, rid bigint, grp bigint, vec binary"), "visits")
    size = members.groupBy("leaf").agg(F.ceil(F.count("*") / limits.members_at_once).cast("int").alias("mparts")).join(visits.groupBy("leaf").agg(F.ceil(F.count("*") / limits.posts_at_once).cast("int").alias("vparts")), "leaf")
    size = F.broadcast(materialise(size, "leaf-sizes"))  # most_leaves rows at most
    part = lambda n: F.pmod(F.xxhash64("rid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    m = members.join(size, "leaf").select("leaf", part("mparts").alias("m"), "vparts", "rid", "grp", "vec").select("leaf", "m", each("vparts").alias("v"), F.lit(True).alias("member"), "rid", "grp", "vec")
    v = visits.join(size, "leaf").select("leaf", part("vparts").alias("v"), "mparts", "rid", "grp", "vec").select("leaf", each("mparts").alias("m"), "v", F.lit(False).alias("member"), "rid", "grp", "vec")
    link = limits.link

    def compare(t: pa.Table) -> pa.Table:
        b = t.combine_chunks().to_batches()[0]
        own = b.column("member").to_numpy(zero_copy_only=False)
        node = _node(b)
        at, to = np.flatnonzero(~own), np.flatnonzero(own)
        y = matrix(b.column("vec").take(pa.array(to)))
        found = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(at), 2048):
            one = at[i : i + 2048]
            p, q = np.nonzero(matrix(b.column("vec").take(pa.array(one))) @ y.T >= link)
            ends = np.stack([node[one[p]], node[to[q]]], 1)
            found.append(np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0))
        ends = np.unique(np.concatenate(found), axis=0)
        return pa.Table.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

    both = v.select("leaf", "m", "v", "member", "rid", "grp", "vec").unionAll(m.select("leaf", "m", "v", "member", "rid", "grp", "vec"))
    return both.groupBy("leaf", "m", "v").applyInArrow(compare, "a bigint, b bigint").distinct()


def odd_links(attached: DataFrame, near: DataFrame, limits: Limits) -> DataFrame:
    """Links (a, b) between posts that no centre explains: posts of no set, and untypical members of sets.

    Exact, and quadratic in these posts only: each is compared with all of its
    model, but for posts of no set that have a link already, which are only met by
    the others. Nodes are as in ``near_links``.
    """
    odd = materialise(attached.filter((F.col("grp") < 0) | (F.col("near") < limits.core)).select("rid", "model", "grp", "vec"), "odd")
    known = near.select(F.explode(F.array("a", "b")).alias("rid")).filter("rid >= 0").distinct()
    some = materialise(odd.join(small(materialise(known, "linked")), "rid", "left_anti"), "odd-alone")
    link = limits.link
    out = attached.sparkSession.createDataFrame([], "a bigint, b bigint")
    for shared in passes(odd, "model", "grp"):

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            other, packed = shared.value
            model = other["model"]
            to = np.where(other["grp"] < 0, other["rid"], -1 - other["grp"])
            for whole in batches:
                for b in slices(whole):
                    mine, own = np.array(b.column("model").to_pylist(), object), _node(b)
                    for m in np.unique(mine):
                        at = np.flatnonzero(mine == m)
                        x = matrix(b.column("vec").take(pa.array(at)))
                        first, last = np.searchsorted(model, m, "left"), np.searchsorted(model, m, "right")
                        for i in range(first, last, 4096):
                            j = min(i + 4096, last)
                            u, v = np.nonzero(x @ unpacked(packed[i:j]).T >= link)
                            one, two = own[at[u]], to[i + v]
                            keep = one != two
                            ends = np.unique(np.sort(np.stack([one[keep], two[keep]], 1), 1), axis=0)
                            if len(ends):
                                yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])

        out = out.unionAll(materialise(some.mapInArrow(compare, "a bigint, b bigint").distinct(), "odd-links"))
    return out


def topics(members: DataFrame) -> DataFrame:
    """For each cluster its most frequent non-null stored topic, the first in string order if tied."""
    counts = members.filter("extra is not null").groupBy("cluster", "model", "extra").agg(F.count("*").alias("n"))
    w = Window.partitionBy("cluster", "model").orderBy(F.desc("n"), "extra")
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("cluster", "model", F.col("extra").alias("topic"))


def described(members: DataFrame, typical: int = 5) -> DataFrame:
    """Each cluster with its size, topic and ``typical`` centre-nearest posts."""
    w = Window.partitionBy("cluster", "model").orderBy(F.desc("similarity"), "key")
    top = members.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= typical)
    near = top.groupBy("cluster", "model").agg(F.max("size").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("rn", "key"))), lambda x: x["key"]).alias("typical_posts"))
    return near.join(topics(members), ["cluster", "model"], "left").select("cluster", "model", "size", "topic", "typical_posts")
