"""Streaming queries, run over all files that are there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans.base import POSTS, posts, query
from quillmark.streaming import jobs


def _events(spark: SparkSession, d: str) -> DataFrame:
    return jobs.stream(spark, f"{d}/events.parquet")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1")
def stream_activity_hourly(spark: SparkSession, d: str) -> DataFrame:
    out = jobs.drain(jobs.hourly(_events(spark, d), "ts", "value"), "update", jobs.newest_update(["hour"]))
    return out.select(F.date_format("hour", "yyyy-MM-dd HH:mm").alias("hour"), "n", F.round("mean_value", 6).alias("mean_value"))


@query("SELECT count(DISTINCT event_id) AS events FROM events")
def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    return jobs.drain(jobs.first_seen(_events(spark, d), ["event_id"], "ts", "40 days"), "append").agg(F.count("*").alias("events"))


@query("""WITH s AS (SELECT user_id, epoch_us(ts) - epoch_us(ts) % 3600000000 - k * 3600000000 AS since FROM events, range(6) t(k)) SELECT user_id, strftime(make_timestamp(since), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS n FROM s GROUP BY 1, since HAVING count(*) > 3""")
def stream_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows of six hours in which a user has more than three events."""
    out = jobs.drain(jobs.rate_limited(_events(spark, d), "user_id", "ts", 21_600, 3), "update", jobs.newest_update(["user_id", "since"]))
    return out.select("user_id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "n")


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 ORDER BY ts, event_id) > 1 AS is_duplicate FROM events")
def stream_dup_flag(spark: SparkSession, d: str) -> DataFrame:
    """Events flagged as duplicates of an earlier one by user, kind and a digit; none is dropped."""
    key = F.concat_ws(":", "user_id", "event_type", F.get_json_object("props", "$.k").cast("bigint") % 10)
    return jobs.flagged(_events(spark, d).withColumn("key", key), "key", "event_id", "ts")


@query("SELECT event_id, round(sum(coalesce(value, 0)) OVER w, 4) AS spent, sum(coalesce(value, 0)) OVER w >= 500.001::DOUBLE AS exhausted FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def stream_budget(spark: SparkSession, d: str) -> DataFrame:
    """Running spending of each user, and whether its budget is used up."""
    return jobs.drain(jobs.budgeted(_events(spark, d), "user_id", "event_id", "value", "ts", 500.001), "append").select("event_id", F.round("spent", 4).alias("spent"), "exhausted")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS at_us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), r AS (SELECT event_id, user_id, rn, at_us AS made, false AS hit FROM e WHERE rn = 1 UNION ALL
SELECT e.event_id, e.user_id, e.rn, CASE WHEN e.at_us - r.made <= 86400000000 THEN r.made ELSE e.at_us END, e.at_us - r.made <= 86400000000 FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1) SELECT event_id, hit FROM r""")
def stream_cache(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user's answer of the last day can be used again; a miss makes a new one."""
    return jobs.drain(jobs.cached_answers(_events(spark, d), "user_id", "event_id", "ts", 86_400), "append")


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS at_us, CAST(trunc(value) AS BIGINT) % 5 AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'error'),
r AS (SELECT event_id, user_id, rn, MAP {x: at_us} AS m, true AS fresh FROM e WHERE rn = 1 UNION ALL SELECT event_id, user_id, rn, CASE WHEN fresh THEN map_from_entries(list_append(kept, {'key': x, 'value': at_us})) ELSE map_from_entries(kept) END, fresh FROM
(SELECT e.event_id, e.user_id, e.rn, e.x, e.at_us, list_filter(map_entries(r.m), lambda q: e.at_us - q.value < 604800000000) AS kept, len(list_filter(map_entries(r.m), lambda q: e.at_us - q.value < 604800000000 AND q.key = e.x)) = 0 AS fresh FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT event_id, CAST(cardinality(m) AS BIGINT) AS n FROM r WHERE fresh""")
def stream_trailing(spark: SparkSession, d: str) -> DataFrame:
    """Distinct texts of a user in the trailing seven days, kept in state."""
    e = _events(spark, d).filter("event_type = 'error'").withColumn("text", (F.col("value").cast("bigint") % 5).cast("string"))
    return jobs.drain(jobs.trailing_distinct(e, "user_id", "event_id", "text", "ts"), "append")


@query(f"""WITH i AS (SELECT post_id, original_text FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY received_at DESC NULLS LAST, original_text DESC NULLS LAST) AS rn FROM post_inputs WHERE post_id IS NOT NULL) WHERE rn = 1), {POSTS}
SELECT i.post_id, CASE WHEN p.original_text IS NOT DISTINCT FROM i.original_text THEN p.sentiment_label END AS sentiment_label, NOT coalesce(p.post_id IS NOT NULL AND p.original_text IS NOT DISTINCT FROM i.original_text AND p.sentiment_label IS NOT NULL, false) AS todo FROM i LEFT JOIN p USING (post_id)""")
def stream_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Arriving posts with the stored label where their text is unchanged; the rest is to do."""
    s = jobs.stream(spark, f"{d}/post_inputs.parquet").select("post_id", "original_text", "received_at").filter("post_id is not null")
    old = posts(spark, d).select("post_id", "original_text", "sentiment_label")
    return jobs.reused(s, old, "post_id", "original_text", "received_at", "sentiment_label").select("post_id", "sentiment_label", "todo")


@query("SELECT video_id, count(*) AS snapshots, max(view_count) AS most FROM video_metric_snapshots GROUP BY video_id")
def stream_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots appended to the series of each video."""
    s = jobs.stream(spark, f"{d}/video_metric_snapshots.parquet").select("video_id", "observed_at", "view_count")
    return jobs.drain(s, "append").groupBy("video_id").agg(F.count("*").alias("snapshots"), F.max("view_count").alias("most"))


@query()
def stream_review_state(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("event_type") == "error", "unsure").when(F.col("event_type") == "signup", "severe").when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "click", "uphold").otherwise("ask")
    e = _events(spark, d).withColumn("verdict", kinds)
    return jobs.drain(jobs.reviews(e, "user_id", "verdict", "ts"), "update", jobs.newest_update(["user_id"]))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def stream_latest_per_user(spark: SparkSession, d: str) -> DataFrame:
    return jobs.upsert_batches(_events(spark, d).select("user_id", "event_id", "ts"), ["user_id"], "ts").select("user_id", "event_id")
