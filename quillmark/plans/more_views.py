"""Sampling within budgets, schedules, spending, script rules and report aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.timeseries import running_sum
from quillmark.plans.base import DETAILS, POSTS, details, posts, query
from quillmark.sources.tables import table

BUDGET = 60


@query(f"""WITH {POSTS}, r AS (SELECT source, post_id, parent_id IS NOT NULL AS reply, row_number() OVER (PARTITION BY source, parent_id IS NOT NULL ORDER BY epoch_us(created_at) NULLS LAST, post_id) AS rn FROM p WHERE source IS NOT NULL),
n AS (SELECT source, count(*) FILTER (NOT reply) AS tops, count(*) FILTER (reply) AS replies FROM r GROUP BY source), b AS (SELECT source, tops, least(replies, {BUDGET} - least(tops, {BUDGET * 2 // 3})) AS take_r FROM n)
SELECT post_id, r.source FROM r JOIN b USING (source) WHERE CASE WHEN reply THEN rn <= take_r ELSE rn <= least(tops, {BUDGET} - take_r) END""")
def budgeted_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Posts of each source within a budget: two thirds are reserved for top-level posts, and what is left over is refilled."""
    r = posts(spark, d).filter("source is not null").select("source", "post_id", F.col("parent_id").isNotNull().alias("reply"), F.unix_micros("created_at").alias("at"))
    n = r.groupBy("source").agg(F.count_if(~F.col("reply")).alias("tops"), F.count_if("reply").alias("replies"))
    b = n.select("source", "tops", F.least(F.col("replies"), F.lit(BUDGET) - F.least(F.col("tops"), F.lit(BUDGET * 2 // 3))).alias("take_r"))
    ranked = r.withColumn("rn", F.row_number().over(Window.partitionBy("source", "reply").orderBy(F.col("at").asc_nulls_last(), "post_id"))).filter(F.col("rn") <= BUDGET)
    take = F.when(F.col("reply"), F.col("take_r")).otherwise(F.least(F.col("tops"), F.lit(BUDGET) - F.col("take_r")))
    return ranked.join(b, "source").filter(F.col("rn") <= take).select("post_id", "source")


@query("SELECT user_id, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS discovered_by FROM events GROUP BY user_id")
def candidate_dedup(spark: SparkSession, d: str) -> DataFrame:
    """One row for each candidate with all that found it."""
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("discovered_by"))


@query(f"WITH {POSTS} SELECT DISTINCT author_ref_hash AS author, source AS node FROM p WHERE author_ref_hash IS NOT NULL AND source IS NOT NULL")
def participation_edges(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).select(F.col("author_ref_hash").alias("author"), F.col("source").alias("node")).dropna().distinct()


@query("""SELECT event_id, strftime(date_trunc('day', ts + INTERVAL 330 MINUTE) + CASE WHEN extract(hour FROM ts + INTERVAL 330 MINUTE) >= 9 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END + INTERVAL 210 MINUTE, '%Y-%m-%d %H:%M') AS next_run FROM events""")
def schedule_next(spark: SparkSession, d: str) -> DataFrame:
    """The next 09:00 at UTC+5:30, in UTC."""
    local = F.col("ts") + F.expr("INTERVAL 330 MINUTES")
    day = F.date_trunc("day", local) + F.when(F.hour(local) >= 9, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    return table(spark, d, "events").select("event_id", F.date_format(day + F.expr("INTERVAL 210 MINUTES"), "yyyy-MM-dd HH:mm").alias("next_run"))


@query(f"""WITH {POSTS}, {DETAILS}, j AS (SELECT p.author_ref_hash AS author, a.metadata.metrics.like_count AS likes, p.post_id FROM p JOIN a USING (post_id) WHERE p.author_ref_hash IS NOT NULL)
SELECT author, count(*) AS comments, CAST(sum(likes) AS BIGINT) AS likes, first(post_id ORDER BY likes DESC NULLS LAST, post_id) AS most_liked FROM j GROUP BY author""")
def author_network_stats(spark: SparkSession, d: str) -> DataFrame:
    """Comments, known likes (null if none is known) and the most liked post of each author."""
    a = details(spark, d).select("post_id", F.col("metadata.metrics.like_count").alias("likes"))
    j = posts(spark, d).filter("author_ref_hash is not null").select("post_id", F.col("author_ref_hash").alias("author")).join(a, "post_id")
    best = F.min_by("post_id", F.struct(F.col("likes").isNull(), -F.col("likes"), F.col("post_id")))
    return j.groupBy("author").agg(F.count("*").alias("comments"), F.sum("likes").alias("likes"), best.alias("most_liked"))


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING), 4) AS spent, sum(value) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id ROWS UNBOUNDED PRECEDING) >= 500.001::DOUBLE AS exhausted FROM events""")
def spend_running(spark: SparkSession, d: str) -> DataFrame:
    """Running spending of each key and whether its credit is used up."""
    e = running_sum(table(spark, d, "events").select("event_id", "user_id", "ts", "value"), ["user_id"], "ts", "event_id", "value", "s")
    return e.select("event_id", F.round("s", 4).alias("spent"), (F.col("s") >= 500.001).alias("exhausted"))


_SCRIPT = "length(regexp_replace(text, '[^\\x{{{0}}}-\\x{{{1}}}]', '', 'g'))"


@query(f"""WITH c AS (SELECT doc_id, {_SCRIPT.format('0B85', '0BB9')} AS ta, {_SCRIPT.format('0905', '0939')} AS hi, length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS la FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, greatest(ta, hi) / nullif((ta + hi + la)::DOUBLE, 0) AS share FROM c)
SELECT doc_id, CASE WHEN share IS NULL THEN 'und' WHEN share >= 0.5 AND ta >= hi THEN 'ta' WHEN share >= 0.5 THEN 'hi' ELSE 'latin' END AS script_lang, CASE WHEN share >= 0.5 THEN round(least(0.99::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * share), 4) END AS confidence, coalesce(share >= 0.5 AND share < 0.9 AND la > 2, false) AS code_mixed FROM s""")
def script_language(spark: SparkSession, d: str) -> DataFrame:
    """Language told by a dominant script, with the confidence its share gives."""
    only = lambda keep: F.length(F.regexp_replace("text", keep, ""))
    c = table(spark, d, "documents").filter("text is not null").select("doc_id", only(r"[^\x{0B85}-\x{0BB9}]").alias("ta"), only(r"[^\x{0905}-\x{0939}]").alias("hi"), only("[^a-zA-Z]").alias("la"))
    share = F.try_divide(F.greatest("ta", "hi").cast("double"), (F.col("ta") + F.col("hi") + F.col("la")).cast("double"))
    s = c.withColumn("share", share)
    sure = F.col("share") >= 0.5
    return s.select(
        "doc_id", F.when(F.col("share").isNull(), "und").when(sure & (F.col("ta") >= F.col("hi")), "ta").when(sure, "hi").otherwise("latin").alias("script_lang"),
        F.when(sure, F.round(F.least(F.lit(0.99), 0.6 + 0.4 * F.col("share")), 4)).alias("confidence"), F.coalesce(sure & (F.col("share") < 0.9) & (F.col("la") > 2), F.lit(False)).alias("code_mixed"),
    )


@query("""WITH b AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(value) AS scored, avg(value) AS score FROM events GROUP BY 1) SELECT round(sum(score * scored) / greatest(1, sum(scored)), 6) AS mean_value, count(*) AS days FROM b""")
def weighted_mean_sentiment(spark: SparkSession, d: str) -> DataFrame:
    """Mean over buckets, each weighted by what it scored."""
    b = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("value").alias("scored"), F.avg("value").alias("score"))
    return b.agg(F.round(F.sum(F.col("score") * F.col("scored")) / F.greatest(F.lit(1), F.sum("scored")), 6).alias("mean_value"), F.count("*").alias("days"))


@query("""WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT event_type FROM t GROUP BY 1 ORDER BY sum(n) DESC, event_type LIMIT 4) SELECT day, CAST(sum(n) AS BIGINT) AS stacked FROM t WHERE event_type IN (SELECT event_type FROM k) GROUP BY day""")
def stacked_top4(spark: SparkSession, d: str) -> DataFrame:
    """Daily totals over the four most frequent kinds."""
    t = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    k = t.groupBy("event_type").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "event_type").limit(4)
    return t.join(k, "event_type", "left_semi").groupBy("day").agg(F.sum("n").alias("stacked"))


@query("""WITH b AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS day FROM events), r AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM b) SELECT day FROM r WHERE i % CAST(ceil(n / 6.0) AS BIGINT) = 0 OR i = n - 1""")
def tick_stride(spark: SparkSession, d: str) -> DataFrame:
    """Every n-th bucket of an axis and the last one; one row for each day is ranked."""
    b = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct()
    r = b.select("day", (F.row_number().over(Window.orderBy("day")) - 1).alias("i"), F.count("*").over(Window.partitionBy()).alias("n"))
    return r.filter((F.col("i") % F.ceil(F.col("n") / 6.0) == 0) | (F.col("i") == F.col("n") - 1)).select("day")
