"""Reply and participation edges, leaders, channel ranking, view rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.latest import latest_by
from quillmark.operators.timeseries import as_of, trailing_count, view_rate
from quillmark.plans.base import POSTS, posts, query
from quillmark.sources.tables import table


def reply_edges_of(p: DataFrame) -> DataFrame:
    """Replies whose parent is in the same scope: from, to, reply, parent."""
    parent = p.select(F.col("post_id").alias("parent_id"), F.col("author").alias("to_author"))
    return p.filter("parent_id is not null").select("parent_id", F.col("post_id").alias("reply_id"), F.col("author").alias("from_author")).join(parent, "parent_id")


def _authored(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select("post_id", "parent_id", F.col("author_ref_hash").alias("author"))


_EDGES = f"{POSTS}, e AS (SELECT r.post_id AS reply_id, r.parent_id, r.author_ref_hash AS from_author, q.author_ref_hash AS to_author FROM p r JOIN p q ON r.parent_id = q.post_id)"


@query(f"WITH {_EDGES} SELECT reply_id, parent_id, from_author, to_author FROM e")
def reply_edges(spark: SparkSession, d: str) -> DataFrame:
    return reply_edges_of(_authored(spark, d)).select("reply_id", "parent_id", "from_author", "to_author")


@query(f"""WITH {_EDGES}, r AS (SELECT to_author AS author, count(DISTINCT from_author) AS unique_repliers FROM e WHERE from_author <> to_author GROUP BY 1), c AS (SELECT author_ref_hash AS author, count(*) AS comments FROM p WHERE author_ref_hash IS NOT NULL GROUP BY 1)
SELECT c.author, coalesce(unique_repliers, 0) AS unique_repliers, comments FROM c LEFT JOIN r USING (author) ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10""")
def unique_repliers_leaders(spark: SparkSession, d: str) -> DataFrame:
    """Ten authors by distinct authors that replied to them, exact; replies to oneself don't count."""
    p = _authored(spark, d)
    r = reply_edges_of(p).filter("from_author <> to_author").groupBy(F.col("to_author").alias("author")).agg(F.countDistinct("from_author").alias("unique_repliers"))
    c = p.filter("author is not null").groupBy("author").agg(F.count("*").alias("comments"))
    return c.join(r, "author", "left").select("author", F.coalesce("unique_repliers", F.lit(0)).alias("unique_repliers"), "comments").orderBy(F.desc("unique_repliers"), F.desc("comments"), "author").limit(10)


@query(f"WITH {_EDGES} SELECT from_author AS author, count(*) AS degree FROM e WHERE from_author IS NOT NULL GROUP BY 1")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return reply_edges_of(_authored(spark, d)).filter("from_author is not null").groupBy(F.col("from_author").alias("author")).agg(F.count("*").alias("degree"))


_SNAP = "s AS (SELECT * FROM (SELECT video_id, observed_at, view_count, row_number() OVER (PARTITION BY video_id, observed_at ORDER BY received_at DESC NULLS LAST, view_count DESC NULLS LAST) AS rn FROM video_metric_snapshots WHERE video_id IS NOT NULL AND observed_at IS NOT NULL) WHERE rn = 1)"
_VID = "v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fetched_at DESC NULLS LAST, view_count DESC NULLS LAST) AS rn FROM videos WHERE video_id IS NOT NULL) WHERE rn = 1)"
_RATE = f"""WITH {_SNAP}, {_VID}, k AS (SELECT * FROM s WHERE view_count IS NOT NULL), m AS (SELECT v.video_id, v.source_group, v.channel_id, v.view_count, v.published_at, v.fetched_at, k.view_count AS prior_views, k.observed_at AS prior_time,
row_number() OVER (PARTITION BY v.video_id ORDER BY k.observed_at DESC NULLS LAST) AS rn FROM v LEFT JOIN k ON k.video_id = v.video_id AND k.observed_at <= v.fetched_at - INTERVAL 1 HOUR),
b AS (SELECT *, CASE WHEN view_count IS NULL THEN 'unavailable' WHEN prior_views IS NOT NULL AND view_count < prior_views THEN 'counter_correction' WHEN prior_views IS NOT NULL THEN 'observed_growth' WHEN epoch_us(fetched_at) >= epoch_us(published_at) THEN 'initial_estimate' ELSE 'unavailable' END AS basis FROM m WHERE rn = 1),
t AS (SELECT video_id, source_group, channel_id, basis, CASE basis WHEN 'observed_growth' THEN (view_count - prior_views) / ((epoch_us(fetched_at) - epoch_us(prior_time)) / 3.6e9) WHEN 'initial_estimate' THEN view_count / greatest((epoch_us(fetched_at) - epoch_us(published_at)) / 3.6e9, 1.0) END AS rate FROM b)"""


def rates(spark: SparkSession, d: str) -> DataFrame:
    """View rate of every video at the time it was last fetched."""
    snaps = latest_by(table(spark, d, "video_metric_snapshots").filter("observed_at is not null"), ["video_id", "observed_at"], "received_at", [F.col("view_count")]).filter("view_count is not null")
    vids = latest_by(table(spark, d, "videos"), ["video_id"], "fetched_at", [F.col("view_count")])
    j = as_of(vids, snaps.select("video_id", "observed_at", "view_count"), "video_id", "fetched_at", "observed_at", ["view_count"], "1 hour")
    rate, basis = view_rate(F.col("view_count"), F.col("prior_view_count"), F.col("prior_time"), F.col("published_at"), F.col("fetched_at"))
    return j.select("video_id", "source_group", "channel_id", basis.alias("basis"), rate.alias("rate"))


@query(f"{_RATE} SELECT video_id, basis, round(rate, 6) AS rate FROM t")
def view_rate_asof(spark: SparkSession, d: str) -> DataFrame:
    return rates(spark, d).select("video_id", "basis", F.round("rate", 6).alias("rate"))


@query(f"""{_RATE}, x AS (SELECT *, row_number() OVER (PARTITION BY source_group, channel_id ORDER BY rate DESC, video_id) AS rn FROM t WHERE rate IS NOT NULL AND source_group IS NOT NULL AND channel_id IS NOT NULL),
c AS (SELECT source_group, channel_id, sum(rate) AS score, count(*) AS videos, CASE WHEN count(DISTINCT basis) = 1 THEN min(basis) ELSE 'mixed' END AS score_basis FROM x WHERE rn <= 3 GROUP BY 1, 2),
y AS (SELECT *, row_number() OVER (PARTITION BY source_group ORDER BY score DESC, channel_id) AS place FROM c)
SELECT source_group, channel_id, round(score, 6) AS score, videos, score_basis, CAST(place AS INTEGER) AS place FROM y WHERE place <= 5""")
def channel_rank_top5_per_group(spark: SparkSession, d: str) -> DataFrame:
    """Channels of each group by the sum of their three best view rates."""
    t = rates(spark, d).filter("rate is not null and source_group is not null and channel_id is not null")
    best = t.withColumn("rn", F.row_number().over(Window.partitionBy("source_group", "channel_id").orderBy(F.desc("rate"), "video_id"))).filter("rn <= 3")
    c = best.groupBy("source_group", "channel_id").agg(F.sum("rate").alias("score"), F.count("*").alias("videos"), F.when(F.min("basis") == F.max("basis"), F.min("basis")).otherwise("mixed").alias("score_basis"))
    y = c.withColumn("place", F.row_number().over(Window.partitionBy("source_group").orderBy(F.desc("score"), "channel_id"))).filter("place <= 5")
    return y.select("source_group", "channel_id", F.round("score", 6).alias("score"), "videos", "score_basis", "place")


@query("""WITH g AS (SELECT event_id, user_id, value, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT user_id, ts, value FROM events WHERE event_type = 'view'),
m AS (SELECT g.event_id, v.value AS prior_value, row_number() OVER (PARTITION BY g.event_id ORDER BY v.ts DESC NULLS LAST, v.value DESC) AS rn FROM g LEFT JOIN v ON g.user_id = v.user_id AND v.ts <= g.ts - INTERVAL 1 HOUR)
SELECT event_id, prior_value FROM m WHERE rn = 1""")
def prior_view_asof(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the value of the same user's latest view an hour or more before."""
    e = table(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("seen_at"), "value")
    return as_of(left, right, "user_id", "ts", "seen_at", ["value"], "1 hour").select("event_id", "prior_value")


@query("""SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS in_minute FROM events""")
def sliding_60s_rate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return trailing_count(e, ["user_id"], "at", 60, "in_minute").select("event_id", "in_minute")


@query("""WITH u AS (SELECT min(event_id) AS event_id, user_id, min(ts) AS ts, round(value, 1) AS text FROM events WHERE event_type = 'error' GROUP BY user_id, round(value, 1)) SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW) AS in_week FROM u""")
def trailing_7d_harsh(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts of a user in the trailing seven days; a repeated text counts once."""
    u = table(spark, d, "events").filter("event_type = 'error'").groupBy("user_id", F.round("value", 1).alias("text")).agg(F.min("event_id").alias("event_id"), F.min(F.col("ts").cast("timestamp")).alias("at"))
    return trailing_count(u, ["user_id"], "at", 7 * 86400, "in_week").select("event_id", "in_week")


@query("""WITH c AS (SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts + INTERVAL 330 MINUTE AS DATE), event_type ORDER BY ts, event_id) AS of_kind, event_type FROM events) SELECT event_id FROM c WHERE event_type <> 'signup' OR of_kind <= 20""")
def daily_budget_running(spark: SparkSession, d: str) -> DataFrame:
    """Calls within a budget of twenty a day at UTC+5:30 for one resource; others pass."""
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    limited = F.coalesce(F.col("event_type") == "signup", F.lit(False))
    w = Window.partitionBy(F.to_date(F.col("ts") + F.expr("INTERVAL 330 MINUTES"))).orderBy("ts", "event_id")
    within = e.filter(limited).withColumn("n", F.row_number().over(w)).filter("n <= 20").select("event_id")
    return within.unionAll(e.filter(~limited & F.col("event_type").isNotNull()).select("event_id"))
