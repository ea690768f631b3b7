import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmark.operators.components import connected_components
from quillmark.operators.gazetteer import entities
from quillmark.operators.latest import latest_by, latest_wide, sieve, sifted
from quillmark.operators.merge import last_write_wins, newest, reuse
from quillmark.operators.similarity import communities, nearest_centroid, pairs_above
from quillmark.operators.timeseries import as_of, running_sum, trailing_count, view_rate
from quillmark.plans.audience import segments
from quillmark.plans.decision_views import estimate_groups, estimate_totals, segment_groups, segment_totals
from quillmark.plans.graph import reply_edges_of
from quillmark.plans.growth_views import comparable, pick_channels
from quillmark.plans.rollups import activity, scope
from quillmark.streaming.jobs import REVIEW_SECONDS, review_step

T0 = datetime(2026, 9, 23, 4)


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", None, "z"), (None, 9, "n"), ("b", None, "q")], "k string, t int, v string")
    assert sorted((r.k, r.v) for r in latest_by(df, ["k"], "t").collect()) == [("a", "y"), ("b", "q")]
    assert latest_by(df.limit(0), ["k"], "t").count() == 0


def test_latest_wide(spark):
    rng = random.Random(1)
    rows = [(f"k{rng.randrange(400)}", rng.randrange(5), f"text {i}") for i in range(600)] + [(None, 1, "n"), ("hot", None, "x")] + [("hot", i, str(i)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, v string")
    want = sorted(map(tuple, latest_by(df, ["k"], "t", [F.col("v")]).collect()))
    out = latest_wide(df, ["k"], "t", [F.col("v")])
    assert sorted(map(tuple, out.collect())) == want and out.columns == df.columns
    assert latest_wide(df.limit(0), ["k"], "t").count() == 0


def test_sieve_finds_all_it_holds(spark):
    df = spark.range(5000).select(F.xxhash64("id").alias("h"))
    own = sifted(df, F.col("h"), sieve(df.limit(2000)), "held")
    assert own.join(df.limit(2000), "h", "left_semi").filter("not held").count() == 0
    assert own.filter("held").count() < 2020


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, 200), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_empty(spark):
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_as_of_and_rate(spark):
    left = spark.createDataFrame([("v", T0, 240), ("w", T0, 5), ("v", None, 1)], "id string, now timestamp, views int")
    right = spark.createDataFrame([("v", T0 - timedelta(days=1), 120), ("v", T0 - timedelta(minutes=30), 200), ("v", None, 7)], "id string, at timestamp, n int")
    j = as_of(left, right, "id", "now", "at", ["n"], "1 hour")
    assert sorted(((r.id, r.prior_n) for r in j.collect()), key=str) == [("v", 120), ("v", None), ("w", None)]
    rate, basis = view_rate(F.col("views"), F.col("prior_n"), F.col("prior_time"), F.lit(T0 - timedelta(days=1)), F.col("now"))
    got = {(r.id, r.views): (r.basis, r.rate) for r in j.select("id", "views", basis.alias("basis"), rate.alias("rate")).collect()}
    assert got[("v", 240)] == ("observed_growth", 5.0)
    assert got[("w", 5)][0] == "initial_estimate"


def test_trailing(spark):
    df = spark.createDataFrame([("a", T0), ("a", T0 + timedelta(seconds=59)), ("a", T0 + timedelta(seconds=60)), ("b", T0)], "k string, t timestamp")
    assert sorted(r.n for r in trailing_count(df, ["k"], "t", 60, "n").collect()) == [1, 1, 2, 2]


def test_slices_of_time(spark):
    rng = random.Random(6)
    rows = [(rng.choice("aab"), T0 + timedelta(seconds=rng.randrange(400_000)), i, float(rng.randrange(9))) for i in range(700)] + [("a", None, 1000, 1.0)]
    df = spark.createDataFrame(rows, "k string, t timestamp, id int, v double")
    got = {r.id: r.n for r in trailing_count(df, ["k"], "t", 1800, "n").collect()}
    assert got == {i: sum(k2 == k and (t2 is None if t is None else t2 is not None and timedelta(0) <= t - t2 < timedelta(seconds=1800)) for k2, t2, _, _ in rows) for k, t, i, _ in rows}
    sums = {r.id: r.s for r in running_sum(df.filter("t is not null"), ["k"], "t", "id", "v", "s").collect()}
    assert all(abs(sums[i] - sum(v2 for k2, t2, i2, v2 in rows if t2 and k2 == k and (t2, i2) <= (t, i))) < 1e-9 for k, t, i, _ in rows if t)
    left = df.select("k", "t", "id")
    right = spark.createDataFrame([(rng.choice("abc"), T0 + timedelta(seconds=rng.randrange(400_000)), i) for i in range(90)], "k string, at timestamp, n int")
    seen = [(r.k, r["at"], r.n) for r in right.collect()]
    got = {r.id: r.prior_n for r in as_of(left, right, "k", "t", "at", ["n"], "1 hour").collect()}
    for k, t, i, _ in rows:
        old = [(a, n) for k2, a, n in seen if t and k2 == k and a + timedelta(hours=1) <= t]
        assert got[i] == (max(old)[1] if old else None)


def test_merge(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "z")], "k int, v string")
    assert sorted(tuple(r) for r in last_write_wins([a, b], ["k"]).collect()) == [(1, "x"), (2, "z")]
    assert newest(a.withColumn("g", F.lit(1)), ["g"], "k", 1, "v").first().k == 2
    old = spark.createDataFrame([(1, "t", 5), (2, "old", 6), (3, None, 7)], "k int, t string, r int")
    new = spark.createDataFrame([(1, "t"), (2, "new"), (3, None), (4, "q")], "k int, t string")
    assert sorted(tuple(r) for r in reuse(new, old, "k", "t", ["r"]).select("k", "r", "todo").collect()) == [(1, 5, False), (2, None, True), (3, 7, False), (4, None, True)]


def test_reply_edges(spark):
    p = spark.createDataFrame([("p", None, "h1"), ("r", "p", "h2"), ("s", "gone", "h2")], "post_id string, parent_id string, author string")
    assert [(r.from_author, r.to_author) for r in reply_edges_of(p).collect()] == [("h2", "h1")]


def test_scope(spark):
    df = spark.createDataFrame([(T0, "g"), (None, "g")], "t timestamp, source_group string")
    with pytest.raises(ValueError):
        scope(df, "t", "2026-02-31", None)
    assert scope(df, "t", "2026-09-24", None).count() == 0
    assert scope(df, "t", "2026-09-23", "2026-09-23", only="g").count() == 1


def test_activity(spark):
    rows = [(datetime(2026, 9, 23, 10, 10), 0.5, "manual:0"), (datetime(2026, 9, 23, 10, 10), -0.5, "manual:1"), (datetime(2026, 9, 23, 12, 10), None, "manual:0")]
    df = spark.createDataFrame(rows, "t timestamp, value double, topic string")
    got = [(r.granularity, r.at, r.label, r.n, r.scored, r.score, r.topics) for r in sorted(activity(df, "t", "value", "topic").collect(), key=lambda r: r.at)]
    assert got == [("hour", "2026-09-23T09:30:00Z", "23/09 15:00", 2, 2, 0.0, "manual:0=1 manual:1=1"), ("hour", "2026-09-23T11:30:00Z", "23/09 17:00", 1, 0, None, "manual:0=1")]
    later = df.unionByName(spark.createDataFrame([(datetime(2026, 9, 28, 10), 0.1, None)], df.schema))
    assert {r.granularity for r in activity(later, "t", "value", "topic").collect()} == {"day"} and activity(df.limit(0), "t", "value", "topic").count() == 0


def test_segments(spark):
    rows = [("student", 0.8), ("student", 0.8), ("student", 0.6), ("parent", 0.8), (None, 0.5)]
    got = segments(spark.createDataFrame(rows, "seg string, c double"), ["seg"], "c", 3).collect()
    assert [(r.value, r.n, r.percent, round(r["mean"], 2)) for r in got] == [("student", 3, 75.0, 0.73)]


def test_suppressed_segments_and_estimates(spark):
    rows = [("student", 0.8), ("student", 0.8), ("student", 0.6), ("parent_family", 0.8), ("unstated", None), (None, None)]
    df = spark.createDataFrame(rows, "s string, c double")
    assert [tuple(r) for r in segment_groups(df, "s", "c").collect()] == [("student", 3, 75.0, 0.73, 1)]
    assert segment_totals(df, "s").first().asDict() == {"estimated": 5, "pending": 1, "classified": 4, "unstated": 1, "hidden_groups": 1}
    assert segment_groups(df.limit(0), "s", "c").count() == 0 and segment_totals(df.limit(0), "s").first().estimated == 0
    rows = [(True, "18-24", "male", "Karnataka", 0.5, False), (True, "18-24", "male", "Karnataka", 0.7, False), (True, "25-34", None, None, None, True), (False, None, None, None, None, False)]
    df = spark.createDataFrame(rows, "known boolean, age string, gender string, state string, confidence double, stale boolean")
    dims = ["age", "gender", "state"]
    got = {(r.dimension, r.value): (r.n, r.percent) for r in estimate_groups(df, dims, "known").collect()}
    assert got == {("age", "18-24"): (2, 66.7), ("gender", "male"): (2, 100.0), ("state", "Karnataka"): (2, 100.0)}
    totals = {r.dimension: (r.total, r.unclear, r.hidden, r.estimated, r.pending, r.stale, r.confidence) for r in estimate_totals(df, dims, "known", "stale", "confidence").collect()}
    assert totals == {"age": (3, 0, 1, 3, 2, 1, 0.6), "gender": (2, 1, 0, 3, 2, 1, 0.6), "state": (2, 1, 0, 3, 2, 1, 0.6)}


def test_comparable_snapshots(spark):
    day = datetime(2026, 9, 23)
    rows = [("old", "k", ["b", "a"], day - timedelta(days=2)), ("before", "k", ["a", "b"], day - timedelta(hours=23, minutes=30)), ("late", "k", ["a", "b"], day - timedelta(hours=22)), ("after", "k", ["b", "a"], day + timedelta(minutes=59)), ("now", "k", ["a", "b"], day + timedelta(hours=5)), ("other", "k", ["a"], day + timedelta(hours=6))]
    got = {r.run_id: (r.before, r.after, r.status) for r in comparable(spark.createDataFrame(rows, "run_id string, source_key string, video_ids array<string>, completed_at timestamp")).collect()}
    assert got["now"] == ("before", "after", "measured_sample")
    assert got["other"] == (None, None, "insufficient_history")


def test_nearest_centroid_blocks(spark):
    rng = random.Random(3)
    cents = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(23)], "g int, centroid array<double>")
    df = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(99, None)], "id int, v array<double>")
    one = {r.id: (r.g, round(r.similarity, 9)) for r in nearest_centroid(df, "id", "v", cents, "g", 0.5, 0.2).collect()}
    many = {r.id: (r.g, round(r.similarity, 9)) for r in nearest_centroid(df, "id", "v", cents, "g", 0.5, 0.2, most=5).collect()}
    assert one == many and len(one) == 40 and {None} < {g for g, _ in one.values()}
    assert nearest_centroid(df, "id", "v", cents.limit(0), "g", 0.5, 0.2).count() == 0


def test_channels_of_two_groups(spark):
    rows = [("a", "x", 9.0), ("a", "y", 8.0), ("a", "z", 7.0), ("b", "x", 5.0), ("b", "w", 4.0)]
    got = [(r.source_group, r.channel_id, r.place) for r in pick_channels(spark.createDataFrame(rows, "source_group string, channel_id string, score double"), ["a", "b"], 2).collect()]
    assert sorted(got) == [("a", "x", 1), ("a", "y", 2), ("b", "w", 1)]


def test_entities(spark):
    df = spark.createDataFrame([("Chennai and chennai, Tamil Nadu; not Chennaiyin. CERT-In",), (None,), ("",)], "t string")
    got = [None if r.e is None else [(x.label, x.text) for x in r.e] for r in df.select(entities(F.col("t")).alias("e")).collect()]
    assert got == [[("GPE", "Chennai"), ("GPE", "chennai"), ("GPE", "Tamil Nadu"), ("ORG", "CERT-In")], None, []]


def test_pairs_and_communities(spark):
    rng = random.Random(4)
    rows = [(i, "g", [rng.gauss(0, 1) for _ in range(6)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id int, g string, v array<double>")
    want = {(a, b) for a, _, x in rows for b, _, y in rows if a < b and sum(p * q for p, q in zip(x, y)) >= 4}
    assert {(r.a, r.b) for r in pairs_above(df, "id", "v", 4.0, block=20).collect()} == want
    assert communities(df, "g", "id", "v", 4.0).count() == 90


def test_review_steps():
    assert review_step(None, "ask", 0) == ("waiting", 0)
    assert review_step(None, "severe", 0) == ("flagged", 0)
    assert review_step(("flagged", 0), "approve", 5) == ("flagged", 0)
    assert review_step(("waiting", 0), "approve", 5) == ("approved", 5)
    assert review_step(("waiting", 0), "approve", REVIEW_SECONDS + 1) == ("expired", REVIEW_SECONDS)
    assert review_step(("upheld", 3), "approve", 9) == ("upheld", 3)


def test_answered_and_cached(spark):
    import pyarrow as pa

    from quillmark.operators.collect import answered, cached, hydrated, owned

    def call(b):
        if any(x is None for x in b.column(1).to_pylist()):
            raise RuntimeError("no model")
        return pa.array([len(x) for x in b.column(1).to_pylist()], pa.int64())

    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None), (4, "dddd")], "id int, t string").coalesce(1)
    assert [r.n for r in answered(df, call, "n", "bigint", at_once=2).orderBy("id").collect()] == [1, 2, None, None]
    cache = spark.createDataFrame([("k1", "x"), ("o2", "y"), ("o1", "z")], "key string, v string")
    keys = [F.concat(F.lit("k"), F.col("id").cast("string")), F.concat(F.lit("o"), F.col("id").cast("string"))]
    assert [(r.v, r.level) for r in cached(df, cache, keys, "v").orderBy("id").collect()] == [("x", 1), ("y", 2), (None, 0), (None, 0)]
    details = spark.createDataFrame([(1, "c", None), (2, "c", False), (4, "gone", True)], "id int, channel_id string, relevant boolean")
    assert [r.id for r in hydrated(df, details, "id", spark.createDataFrame([("c",)], "channel_id string"), relevant="relevant").collect()] == [1]
    chosen = spark.createDataFrame([("c", ["v", "w"]), ("b", ["v"])], "channel_id string, video_ids array<string>")
    p = spark.createDataFrame([("p", "v"), ("q", "z"), ("r", None)], "post_id string, video_id string")
    assert sorted((r.post_id, r.channel_id) for r in owned(p, chosen).collect()) == [("p", "b"), ("q", None), ("r", None)]


def test_sinks(spark, tmp_path):
    from quillmark.sinks import files

    df = spark.createDataFrame([("seed:1", "seed", 1), ("a", "x", None), ("b", None, 2)], "post_id string, source string, n int")
    status = files.persist_corpus(df, ["n"], ["source"], f"file://{tmp_path}/c")
    assert status == {"results": 1, "details": 2, "errors": []}
    assert files.upsert(spark.createDataFrame([("b", 9), ("c", 1)], "post_id string, n int"), f"file://{tmp_path}/c/results", ["post_id"]) == 2
    assert sorted(tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/c/results").collect()) == [("b", 9), ("c", 1)]
    (tmp_path / "bad").write_text("a file where a folder should be")
    assert files.persist_corpus(df, ["n"], ["source"], f"file://{tmp_path}/bad")["errors"]
    assert files.persist_run("r", df, f"file://{tmp_path}") == (3, 3)


def test_options(spark, tmp_path):
    from quillmark.options import Options, load

    (tmp_path / "o").write_text("# note\nQUILLMARK_BATCH=7\ngroup='x'\nunknown=1\nquestions=no\n")
    assert load(env={}) == Options()
    assert load(str(tmp_path / "o"), spark, {"QUILLMARK_BATCH": "9", "OTHER": "1"}) == Options(batch=9, group="x", questions=False)
    with pytest.raises(ValueError):
        load(env={"QUILLMARK_QUESTIONS": "perhaps"})


def test_media_rules(spark):
    from quillmark.sources import media

    box = lambda *b: F.array(*[F.lit(float(x)) for x in b])
    row = spark.range(1).select(media.clean_box(box(-5, 0.4, 2000, 10)).alias("a"), media.clean_box(box(5, 0, 5, 9)).alias("b"), media.hide_box(media.clean_box(box(100, 100, 200, 200))).alias("c"), media.union_box(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), F.array(F.lit(0), F.lit(5), F.lit(2), F.lit(9))).alias("d")).first()
    assert (row.a, row.b, row.c, row.d) == ([0, 0, 1000, 10], None, [75, 85, 225, 215], [0, 2, 3, 9])
    said = [(True, None, None, "labelled_ai"), (False, None, None, "unavailable"), (False, "likely_ai", 0.3, "cant_tell"), (False, "likely_ai", 0.8, "likely_ai"), (False, "likely_authentic", 0.9, "no_ai_signs"), (False, "odd", 0.9, "cant_tell")]
    df = spark.createDataFrame(said, "a boolean, m string, c double, want string")
    assert all(r.got == r.want for r in df.withColumn("got", media.verdict(F.col("a"), F.col("m"), F.col("c"))).collect())
