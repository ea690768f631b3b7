"""Overview, histograms and topic rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.math import ist
from quillmark.plans.base import DETAILS, POSTS, details, posts, query
from quillmark.sources.tables import table


def count_if(c) -> "F.Column":
    return F.count_if(c)


@query("""SELECT count(*) AS records, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases,
count(*) FILTER (event_type NOT IN ('click','view','purchase') OR event_type IS NULL) AS other, round(sum(coalesce(value, 0)), 4) AS engagement,
strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_at FROM events""")
def overview_counts(spark: SparkSession, d: str) -> DataFrame:
    """Row count, histogram over a fixed domain, engagement and sample window in one pass."""
    e, kind = table(spark, d, "events"), F.col("event_type")
    fmt = "yyyy-MM-dd HH:mm:ss"
    known = ["click", "view", "purchase"]
    return e.agg(
        F.count("*").alias("records"), count_if(kind == "click").alias("clicks"), count_if(kind == "view").alias("views"), count_if(kind == "purchase").alias("purchases"),
        count_if(~F.coalesce(kind.isin(known), F.lit(False))).alias("other"), F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("engagement"),
        F.date_format(F.min("ts"), fmt).alias("first_at"), F.date_format(F.max("ts"), fmt).alias("last_at"),
    )


@query("""SELECT event_type, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-12' AND event_type = 'view' GROUP BY event_type""")
def scope_filter_dates_group(spark: SparkSession, d: str) -> DataFrame:
    """Inclusive UTC date range and one group; the range reaches the scan as a range on ``ts``."""
    e = scope(table(spark, d, "events"), "ts", "2024-01-05", "2024-01-12", "event_type", "view")
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


def scope(df: DataFrame, time: str, since: str | None, until: str | None, group: str = "source_group", only: str | None = None) -> DataFrame:
    """Rows of an inclusive date range and a group. Dates must exist; a null time fails a bounded range."""
    from datetime import date, timedelta

    if since:
        df = df.filter(F.col(time) >= F.lit(date.fromisoformat(since).isoformat()).cast("timestamp_ntz" if dict(df.dtypes)[time] == "timestamp_ntz" else "timestamp"))
    if until:
        df = df.filter(F.col(time) < F.lit((date.fromisoformat(until) + timedelta(1)).isoformat()).cast("timestamp_ntz" if dict(df.dtypes)[time] == "timestamp_ntz" else "timestamp"))
    return df.filter(F.col(group) == only) if only else df


@query(f"""WITH {POSTS} SELECT source, count(*) AS posts, count(*) FILTER (sentiment_label = 'positive') AS positive, count(*) FILTER (sentiment_label = 'neutral') AS neutral, count(*) FILTER (sentiment_label = 'negative') AS negative,
count(*) FILTER (sentiment_label IS NULL OR sentiment_label NOT IN ('positive','neutral','negative')) AS unavailable FROM p GROUP BY source""")
def sentiment_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Sentiment labels over a fixed domain for each source; null is unavailable."""
    label = F.col("sentiment_label")
    known = ["positive", "neutral", "negative"]
    return posts(spark, d).groupBy("source").agg(F.count("*").alias("posts"), *[count_if(label == k).alias(k) for k in known], count_if(~F.coalesce(label.isin(known), F.lit(False))).alias("unavailable"))


@query("""SELECT CASE WHEN coalesce(is_code_mixed, false) OR coalesce(lang_confidence, 0) < 0.8 THEN 'und' ELSE coalesce(nullif(primary_lang, ''), 'und') END AS language, count(*) AS posts FROM language_info GROUP BY 1""")
def language_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Displayed language: undetermined where mixed or below .8 confidence."""
    shown = F.when(F.coalesce("is_code_mixed", F.lit(False)) | (F.coalesce("lang_confidence", F.lit(0.0)) < 0.8), "und").otherwise(F.coalesce(F.nullif("primary_lang", F.lit("")), F.lit("und")))
    return table(spark, d, "language_info").groupBy(shown.alias("language")).agg(F.count("*").alias("posts"))


@query(f"WITH {POSTS} SELECT coalesce(sentiment_source, 'pending') AS sentiment_source, count(*) AS posts FROM p GROUP BY 1")
def source_histogram_pending(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy(F.coalesce("sentiment_source", F.lit("pending")).alias("sentiment_source")).agg(F.count("*").alias("posts"))


@query(f"WITH {POSTS} SELECT coalesce(event_severity, 0) AS severity, coalesce(event_polarity, 'none') AS polarity, count(*) AS posts FROM p GROUP BY 1, 2")
def severity_histogram(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).groupBy(F.coalesce("event_severity", F.lit(0.0)).alias("severity"), F.coalesce("event_polarity", F.lit("none")).alias("polarity")).agg(F.count("*").alias("posts"))


@query(f"""WITH {DETAILS}, r AS (SELECT topic, source_url, row_number() OVER (PARTITION BY topic ORDER BY epoch_us(created_at) NULLS LAST, post_id) AS rn FROM a WHERE topic IS NOT NULL AND source_url IS NOT NULL)
SELECT topic, string_agg(source_url, ' ' ORDER BY rn) AS evidence FROM r WHERE rn <= 3 GROUP BY topic""")
def topic_evidence_first3(spark: SparkSession, d: str) -> DataFrame:
    """The first three evidence links of each topic in order of time."""
    w = Window.partitionBy("topic").orderBy(F.unix_micros("created_at").asc_nulls_last(), "post_id")
    r = details(spark, d).filter("topic is not null and source_url is not null").withColumn("rn", F.row_number().over(w)).filter("rn <= 3")
    urls = F.transform(F.array_sort(F.collect_list(F.struct("rn", "source_url"))), lambda x: x["source_url"])
    return r.groupBy("topic").agg(F.array_join(urls, " ").alias("evidence"))


@query(f"""WITH {DETAILS} SELECT source AS author, count(*) AS posts, CAST(sum(coalesce(metadata.metrics.like_count, 0) + coalesce(metadata.metrics.reply_count, 0)) AS BIGINT) AS engagement FROM a GROUP BY source ORDER BY engagement DESC, author LIMIT 5""")
def engagement_top5(spark: SparkSession, d: str) -> DataFrame:
    """Engagement is the sum of known counters; the five sources with the most."""
    n = lambda c: F.coalesce(F.col(f"metadata.metrics.{c}"), F.lit(0))
    return details(spark, d).groupBy(F.col("source").alias("author")).agg(F.count("*").alias("posts"), F.sum(n("like_count") + n("reply_count")).alias("engagement")).orderBy(F.desc("engagement"), "author").limit(5)


@query("""SELECT user_id, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id LIMIT 5""")
def author_top5(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).orderBy(F.desc("total"), "user_id").limit(5)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(value) AS scored, round(avg(value), 6) AS mean_value, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1""")
def timeline_daily_utc(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count("value").alias("scored"), F.round(F.avg("value"), 6).alias("mean_value"), count_if(F.col("event_type") == "error").alias("errors"))


def activity(df: DataFrame, time: str, value: str, topic: str) -> DataFrame:
    """Hourly buckets if the rows span less than 48 hours, else daily ones, at UTC+5:30.

    ``granularity``, ``at`` (UTC start of an hour, or the day), ``label``, ``n``,
    ``scored``, ``score`` (mean of known values), ``topics`` (``name=count`` in order
    of name). Rows without a time are left out. The span is one small aggregate,
    joined by a broadcast of one row; topics are counted before they are listed.
    """
    at = F.col(time).cast("timestamp")
    span = df.agg((F.max(F.unix_micros(at)) - F.min(F.unix_micros(at))).alias("span"))
    local = ist(F.col(time))
    hourly = F.col("span") < 48 * 3_600_000_000
    start = F.when(hourly, F.date_trunc("hour", local)).otherwise(F.date_trunc("day", local))
    rows = df.filter(F.col(time).isNotNull()).crossJoin(F.broadcast(span)).select(hourly.alias("hourly"), start.alias("start"), F.col(value).alias("x"), F.col(topic).alias("topic"))
    per = rows.groupBy("hourly", "start", "topic").agg(F.count("*").alias("n"), F.count("x").alias("scored"), F.sum("x").alias("total"))
    listed = F.array_sort(F.collect_list(F.when(F.col("topic").isNotNull(), F.concat("topic", F.lit("="), F.col("n").cast("string")))))
    b = per.groupBy("hourly", "start").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.sum("total").alias("total"), F.array_join(listed, " ").alias("topics"))
    utc = F.date_format(F.col("start") - F.expr("INTERVAL 330 MINUTES"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    day = F.date_format("start", "yyyy-MM-dd")
    return b.select(
        F.when(F.col("hourly"), "hour").otherwise("day").alias("granularity"), F.when(F.col("hourly"), utc).otherwise(day).alias("at"), F.when(F.col("hourly"), F.date_format("start", "dd/MM HH:00")).otherwise(day).alias("label"),
        "n", "scored", F.try_divide(F.col("total"), F.col("scored").cast("double")).alias("score"), "topics",
    )


_ACTIVITY = """WITH e AS (SELECT * FROM events WHERE {0}), s AS (SELECT epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM e), b AS (SELECT span < 172800000000 AS hourly, CASE WHEN span < 172800000000 THEN date_trunc('hour', ts + INTERVAL 330 MINUTE) ELSE CAST(CAST(ts + INTERVAL 330 MINUTE AS DATE) AS TIMESTAMP) END AS start, value, event_type FROM e, s),
t AS (SELECT hourly, start, event_type, count(*) AS n, count(value) AS scored, sum(value) AS total FROM b GROUP BY ALL)
SELECT CASE WHEN hourly THEN 'hour' ELSE 'day' END AS granularity, CASE WHEN hourly THEN strftime(start - INTERVAL 330 MINUTE, '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(start, '%Y-%m-%d') END AS "at", CASE WHEN hourly THEN strftime(start, '%d/%m %H:00') ELSE strftime(start, '%Y-%m-%d') END AS label, CAST(sum(n) AS BIGINT) AS n, CAST(sum(scored) AS BIGINT) AS scored, round(sum(total) / sum(scored), 6) AS score, string_agg(event_type || '=' || n, ' ' ORDER BY event_type) AS topics FROM t GROUP BY hourly, start"""


def _activity(df: DataFrame) -> DataFrame:
    return activity(df, "ts", "value", "event_type").withColumn("score", F.round("score", 6))


@query(_ACTIVITY.format("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11'"))
def activity_hourly(spark: SparkSession, d: str) -> DataFrame:
    return _activity(scope(table(spark, d, "events"), "ts", "2024-01-10", "2024-01-10"))


@query(_ACTIVITY.format("true"))
def activity_daily(spark: SparkSession, d: str) -> DataFrame:
    return _activity(table(spark, d, "events"))


@query("""WITH u AS (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS commenters, count(*) FILTER (n = 1) AS one_time, count(*) FILTER (n > 1) AS repeat, CAST(sum(n) AS BIGINT) AS rows FROM u""")
def participation(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return u.agg(F.count("*").alias("commenters"), count_if(F.col("n") == 1).alias("one_time"), count_if(F.col("n") > 1).alias("repeat"), F.sum("n").alias("rows"))


@query("""WITH h AS (SELECT CAST(extract(hour FROM ts + INTERVAL 330 MINUTE) AS INTEGER) AS h FROM events), b AS (SELECT CASE WHEN h >= 22 OR h < 6 THEN 'Night' WHEN h < 12 THEN 'Morning' WHEN h < 17 THEN 'Afternoon' ELSE 'Evening' END AS part FROM h)
SELECT d.part, count(b.part) AS n FROM (VALUES ('Night'), ('Morning'), ('Afternoon'), ('Evening')) d(part) LEFT JOIN b USING (part) GROUP BY d.part""")
def time_of_day_ist(spark: SparkSession, d: str) -> DataFrame:
    """Four parts of the day at UTC+5:30, empty ones included."""
    h = F.hour(ist(F.col("ts")))
    part = F.when((h >= 22) | (h < 6), "Night").when(h < 12, "Morning").when(h < 17, "Afternoon").otherwise("Evening")
    n = table(spark, d, "events").groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    parts = spark.createDataFrame([("Night",), ("Morning",), ("Afternoon",), ("Evening",)], "part string")
    return parts.join(n, "part", "left").select("part", F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS percent FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def percent_of_total(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("l_returnflag")), 6))


@query("""WITH c AS (SELECT n_name AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, label) AS rn FROM c)
SELECT CASE WHEN rn > 19 THEN 'Other' ELSE label END AS label, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def other_folding_top19(spark: SparkSession, d: str) -> DataFrame:
    """The 19 most frequent labels and the rest as one row; the ranking runs over one row for each label."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("label"), "n")
    r = c.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("n"), "label")))
    return r.groupBy(F.when(F.col("rn") > 19, "Other").otherwise(F.col("label")).alias("label")).agg(F.sum("n").alias("n"))


@query(f"""WITH {POSTS} SELECT post_id, event_severity AS severity FROM p WHERE event_polarity = 'negative' ORDER BY event_severity DESC NULLS LAST, post_id LIMIT 50""")
def alerting_worst_first(spark: SparkSession, d: str) -> DataFrame:
    """The fifty worst negative events."""
    return posts(spark, d).filter("event_polarity = 'negative'").select("post_id", F.col("event_severity").alias("severity")).orderBy(F.desc_nulls_last("severity"), "post_id").limit(50)


@query(f"WITH {POSTS} SELECT content_hash, count(*) AS posts, min(post_id) AS first_post FROM p WHERE content_hash IS NOT NULL GROUP BY content_hash HAVING count(*) > 1")
def hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).filter("content_hash is not null").groupBy("content_hash").agg(F.count("*").alias("posts"), F.min("post_id").alias("first_post")).filter("posts > 1")
