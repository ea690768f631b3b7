"""Comparable snapshots, measured topic growth, channel selection across groups, latest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.math import unit
from quillmark.operators.latest import latest_by
from quillmark.operators.similarity import centroids, nearest_centroid
from quillmark.plans.base import query
from quillmark.plans.graph import _RATE, rates
from quillmark.sources.tables import table

CLUSTERED = ("BERTopic", "Embedding clusters")


def comparable(runs: DataFrame, run: str = "run_id", source: str = "source_key", videos: str = "video_ids", done: str = "completed_at") -> DataFrame:
    """For each run the two earlier snapshots its growth is measured between, and whether there is enough history.

    ``end`` is the UTC day on which the run was completed; ``after`` is the earliest
    run of the same source and the same set of videos completed within an hour of
    ``end``, ``before`` within an hour of the day before; some such run must be two
    days old. Only the first run of an hour after midnight can be either, so these
    are reduced by (source, videos, day) first and found by an equi-join.
    """
    day = F.date_trunc("day", F.col(done))
    r = runs.select(F.col(run).alias("run_id"), F.col(source).alias("source_key"), F.array_sort(videos).alias("set"), F.col(done).alias("done"), day.alias("end"))
    first = r.filter(F.col("done") < F.col("end") + F.expr("INTERVAL 1 HOUR")).groupBy("source_key", "set", F.col("end").alias("at")).agg(F.min_by("run_id", F.struct("done", "run_id")).alias("id"))
    oldest = r.groupBy("source_key", "set").agg(F.min("done").alias("oldest"))
    side = lambda name: first.select("source_key", "set", (F.col("at") + F.expr("INTERVAL 1 DAY") if name == "before" else F.col("at")).alias("end"), F.col("id").alias(name))
    j = r.join(side("before"), ["source_key", "set", "end"], "left").join(side("after"), ["source_key", "set", "end"], "left").join(oldest, ["source_key", "set"])
    known = F.col("before").isNotNull() & F.col("after").isNotNull() & (F.col("oldest") <= F.col("end") - F.expr("INTERVAL 2 DAYS"))
    return j.select("run_id", "end", "before", "after", F.when(known, "measured_sample").otherwise("insufficient_history").alias("status"))


_RUNS = "r AS (SELECT user_id || ':' || strftime(date_trunc('hour', ts), '%Y%m%d%H') AS run_id, user_id AS source_key, list_sort(list(DISTINCT event_type)) AS s, max(ts) AS done, date_trunc('day', max(ts)) AS day_end FROM events GROUP BY user_id, date_trunc('hour', ts))"


@query(f"""WITH {_RUNS}, k AS (SELECT r.run_id, r.day_end, r.source_key, r.s, (SELECT first(b.run_id ORDER BY b.done, b.run_id) FROM r b WHERE b.source_key = r.source_key AND b.s = r.s AND b.done >= r.day_end - INTERVAL 1 DAY AND b.done < r.day_end - INTERVAL 23 HOUR) AS before,
(SELECT first(b.run_id ORDER BY b.done, b.run_id) FROM r b WHERE b.source_key = r.source_key AND b.s = r.s AND b.done >= r.day_end AND b.done < r.day_end + INTERVAL 1 HOUR) AS after, (SELECT min(b.done) FROM r b WHERE b.source_key = r.source_key AND b.s = r.s) AS oldest FROM r)
SELECT run_id, before, after, CASE WHEN before IS NOT NULL AND after IS NOT NULL AND oldest <= day_end - INTERVAL 2 DAY THEN 'measured_sample' ELSE 'insufficient_history' END AS status FROM k""")
def snapshot_asof_hour(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's hours with the snapshots of the same set of kinds around their day's start."""
    hour = F.date_trunc("hour", "ts")
    runs = table(spark, d, "events").groupBy("user_id", hour.alias("hour")).agg(F.sort_array(F.collect_set("event_type")).alias("video_ids"), F.max("ts").alias("completed_at"))
    runs = runs.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.date_format("hour", "yyyyMMddHH")).alias("run_id"), F.col("user_id").alias("source_key"), "video_ids", "completed_at")
    return comparable(runs).select("run_id", "before", "after", "status")


def usable(df: DataFrame, vector: str, size: int = 384) -> DataFrame:
    """Rows whose vector has ``size`` finite numbers that are not all zero, scaled to length one."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return df.filter((F.size(vector) == size) & ~bad & some).withColumn(vector, unit(F.col(vector)))


def measured_growth(posts: DataFrame, cents: DataFrame, topic: str, key: str, vector: str, at: str, floor: float = 0.65, margin: float = 0.05) -> DataFrame:
    """``topic``, ``previous``, ``current``, ``change`` over the two whole UTC days before the day of the newest post.

    A post counts for the topic whose centroid is nearest, if it is near enough and
    leads the second; the others are counted under a null topic. Topics that match
    nobody have zeros.
    """
    end = posts.agg(F.date_trunc("day", F.max(at)).alias("end"))
    near = nearest_centroid(posts, key, vector, cents, topic, floor, margin).select(key, topic)
    windowed = posts.select(key, at).crossJoin(F.broadcast(end)).filter((F.col(at) >= F.col("end") - F.expr("INTERVAL 2 DAYS")) & (F.col(at) < F.col("end")))
    current = F.col(at) >= F.col("end") - F.expr("INTERVAL 1 DAY")
    n = windowed.join(near, key).groupBy(topic).agg(F.count_if(~current).alias("previous"), F.count_if(current).alias("current"))
    names = cents.select(topic).unionAll(cents.sparkSession.createDataFrame([(None,)], cents.select(topic).schema))
    out = names.join(n, names[topic].eqNullSafe(n[topic]), "left").select(names[topic], *[F.coalesce(c, F.lit(0)).alias(c) for c in ("previous", "current")])
    return out.withColumn("change", F.col("current") - F.col("previous"))


_VEC = """v AS (SELECT post_id, topic, topic_source, created_at, embedding::DOUBLE[] AS e FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY updated_at DESC NULLS LAST, topic DESC NULLS LAST, topic_source DESC NULLS LAST) AS rn FROM argus_post_details WHERE post_id IS NOT NULL)
WHERE rn = 1 AND len(embedding) = 384 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0), u AS (SELECT post_id, topic, topic_source, created_at, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
s AS (SELECT topic, i AS pos, sum(e[i]) AS x FROM u, range(1, 385) t(i) WHERE topic IS NOT NULL AND topic_source IN ('BERTopic', 'Embedding clusters') GROUP BY 1, 2), n AS (SELECT topic, sqrt(sum(x * x)) AS len FROM s GROUP BY topic), c AS (SELECT topic, list(x / len ORDER BY pos) AS c FROM s JOIN n USING (topic) WHERE len > 0 GROUP BY topic)"""


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "argus_post_details").select("post_id", "topic", "topic_source", "created_at", "updated_at", F.col("embedding").cast("array<double>").alias("embedding"))
    return usable(latest_by(df, ["post_id"], "updated_at", [F.col("topic"), F.col("topic_source")]), "embedding")


@query(f"""WITH {_VEC}, m AS (SELECT post_id, created_at, topic, list_dot_product(e, c) AS s FROM (SELECT post_id, created_at, e FROM u), c), r AS (SELECT *, row_number() OVER w AS rn, lead(s) OVER w AS second FROM m WINDOW w AS (PARTITION BY post_id ORDER BY s DESC, topic)),
b AS (SELECT created_at, CASE WHEN s >= 0.65 AND (second IS NULL OR s - second >= 0.05) THEN topic END AS topic FROM r WHERE rn = 1), e AS (SELECT date_trunc('day', max(created_at)) AS d FROM u),
k AS (SELECT topic, created_at >= d - INTERVAL 1 DAY AS now FROM b, e WHERE created_at >= d - INTERVAL 2 DAY AND created_at < d), t AS (SELECT topic FROM c UNION ALL SELECT NULL)
SELECT t.topic, count(*) FILTER (NOT now) AS previous, count(*) FILTER (now) AS current, count(*) FILTER (now) - count(*) FILTER (NOT now) AS change FROM t LEFT JOIN k ON t.topic IS NOT DISTINCT FROM k.topic GROUP BY t.topic""")
def topic_growth(spark: SparkSession, d: str) -> DataFrame:
    """Change of topics between two whole days, posts matched to centroids; ambiguous ones under a null topic."""
    v = _vectors(spark, d)
    cents = centroids(v.filter(F.col("topic").isNotNull() & F.col("topic_source").isin(*CLUSTERED)), "topic", "embedding")
    return measured_growth(v.select("post_id", "created_at", "embedding"), cents, "topic", "post_id", "embedding", "created_at")


def pick_channels(scored: DataFrame, groups: list[str], most: int = 5) -> DataFrame:
    """The ``most`` best channels of each group, in order of the groups; a channel taken by one is left out of the next.

    ``scored`` has one row for each (group, channel) and a ``score``; the groups are
    a fixed short list, and a group's ranking is a top ``most`` with a limit before
    the shuffle.
    """
    out = None
    for g in groups:
        free = scored.filter(F.col("source_group") == g)
        if out is not None:
            free = free.join(F.broadcast(out.select("channel_id")), "channel_id", "left_anti")
        best = free.orderBy(F.desc("score"), "channel_id").limit(most)
        best = best.withColumn("place", F.row_number().over(Window.partitionBy("source_group").orderBy(F.desc("score"), "channel_id"))).select(scored.columns + ["place"])
        out = best if out is None else out.unionByName(best)
    assert out is not None, "no group"
    return out


_BEST = f"""{_RATE}, x AS (SELECT t.*, row_number() OVER (PARTITION BY source_group, channel_id ORDER BY rate DESC, video_id) AS rn FROM t WHERE rate IS NOT NULL AND source_group IS NOT NULL AND channel_id IN (SELECT channel_id FROM channels)),
c AS (SELECT source_group, channel_id, sum(rate) AS score, CASE WHEN count(DISTINCT basis) = 1 THEN min(basis) ELSE 'mixed' END AS score_basis, sum(CASE WHEN basis = 'observed_growth' THEN rate ELSE 0 END) AS observed_growth, string_agg(video_id, ' ' ORDER BY rn) FILTER (rn <= 2) AS video_ids FROM x WHERE rn <= 3 GROUP BY 1, 2)"""


@query(f"""{_BEST}, g1 AS (SELECT *, row_number() OVER (ORDER BY score DESC, channel_id) AS place FROM c WHERE source_group = 'local' QUALIFY place <= 5), g2 AS (SELECT *, row_number() OVER (ORDER BY score DESC, channel_id) AS place FROM c WHERE source_group = 'state' AND channel_id NOT IN (SELECT channel_id FROM g1) QUALIFY place <= 5)
SELECT source_group, channel_id, round(score, 6) AS score, score_basis, round(observed_growth, 6) AS observed_growth, video_ids, CAST(place AS INTEGER) AS place FROM (SELECT * FROM g1 UNION ALL SELECT * FROM g2)""")
def channel_selection(spark: SparkSession, d: str) -> DataFrame:
    """Known channels of two groups by their three best view rates, each channel once, with the two best videos."""
    t = rates(spark, d).filter("rate is not null and source_group is not null").join(F.broadcast(table(spark, d, "channels").select("channel_id").distinct()), "channel_id", "left_semi")
    best = t.withColumn("rn", F.row_number().over(Window.partitionBy("source_group", "channel_id").orderBy(F.desc("rate"), "video_id"))).filter("rn <= 3")
    two = F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rn", "video_id"))), lambda x: x["video_id"]), 1, 2)
    c = best.groupBy("source_group", "channel_id").agg(
        F.sum("rate").alias("score"), F.when(F.min("basis") == F.max("basis"), F.min("basis")).otherwise("mixed").alias("score_basis"),
        F.sum(F.when(F.col("basis") == "observed_growth", F.col("rate")).otherwise(0.0)).alias("observed_growth"), F.array_join(two, " ").alias("video_ids"),
    )
    return pick_channels(c, ["local", "state"]).select("source_group", "channel_id", F.round("score", 6).alias("score"), "score_basis", F.round("observed_growth", 6).alias("observed_growth"), "video_ids", "place")


@query("SELECT user_id, max_by(event_id, event_id) AS run, max_by(event_type, event_id) AS status FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id")
def latest_finished_run(spark: SparkSession, d: str) -> DataFrame:
    """The newest run of each source that ended well."""
    done = table(spark, d, "events").filter(F.col("event_type").isin("purchase", "signup"))
    return done.groupBy("user_id").agg(F.max("event_id").alias("run"), F.max_by("event_type", "event_id").alias("status"))


@query("""WITH r AS (SELECT user_id, event_type, count(*) AS records, count(DISTINCT CAST(json_extract(props, '$.k') AS BIGINT)) AS videos FROM events GROUP BY 1, 2) SELECT user_id, event_type, records FROM r WHERE event_type <> 'error' AND NOT (records <= greatest(1, videos))""")
def run_filter(spark: SparkSession, d: str) -> DataFrame:
    """Finished runs that hold more than one record for each video."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    r = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("records"), F.countDistinct(k).alias("videos"))
    return r.filter((F.col("event_type") != "error") & ~(F.col("records") <= F.greatest(F.lit(1), "videos"))).select("user_id", "event_type", "records")
