"""Small rules over one row: signed scores, suppressed shares with derived counts, daily budgets, reviews without an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import decisions as D
from quillmark.functions.math import half_up, ist, safe_count
from quillmark.plans.base import POSTS, posts, query
from quillmark.sources.tables import table


@query(f"""WITH {POSTS}, s AS (SELECT post_id, greatest(-1, least(1, sentiment_confidence - aggression_score)) AS s FROM p) SELECT post_id, round(s, 6) AS score, CASE WHEN s >= 0.05 THEN 'positive' WHEN s <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, round(least(1.0::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * abs(s)), 4) AS confidence FROM s WHERE s IS NOT NULL""")
def signed_scores(spark: SparkSession, d: str) -> DataFrame:
    """Two probabilities as one signed score, its label and the confidence of an answer of that strength."""
    s = posts(spark, d).select("post_id", D.signed_score(F.col("sentiment_confidence"), F.col("aggression_score")).alias("s")).filter("sentiment_confidence is not null and aggression_score is not null")
    return s.select("post_id", F.round("s", 6).alias("score"), D.label_of(F.col("s")).alias("label"), D.answer_confidence(F.col("s")).alias("confidence"))


def suppressed(percent: Column, count: Column, flag: Column, sample: Column, survey: Column) -> dict[str, Column]:
    """``count`` (derived from the sample where it is not given), ``suppressed`` and the ``percent`` that may be shown.

    Counts under ten are withheld, and in a survey all that have no count.
    """
    n = F.coalesce(count, F.floor(sample * percent / 100))
    hide = F.coalesce(flag, F.lit(False)) | F.coalesce(n < 10, F.lit(False)) | (survey & n.isNull())
    return {"count": n, "suppressed": hide, "percent": F.when(~hide, percent)}


@query("""WITH c AS (SELECT n_name AS label, n_regionkey AS r, count(*) AS n, n_nationkey % 3 AS how FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY r) AS total FROM c), s AS (SELECT label, floor(n * 100.0::DOUBLE / total * 100 + 0.5) / 100 AS percent, CASE WHEN how = 0 THEN n END AS given, how, CASE WHEN how = 1 THEN total END AS sample, r FROM t),
d AS (SELECT *, coalesce(given, CAST(floor(sample * percent / 100) AS BIGINT)) AS count FROM s), h AS (SELECT *, coalesce(count < 60, false) OR (r < 3 AND count IS NULL) OR how = 2 AND r = 4 AS suppressed FROM d) SELECT label, count, suppressed, CASE WHEN NOT suppressed THEN percent END AS percent FROM (SELECT label, count, coalesce(count < 10, false) OR (r < 3 AND count IS NULL) OR (how = 2 AND r = 4) AS suppressed, percent FROM h)""")
def suppressed_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares with counts given, derived or missing; some regions are surveys, some rows are flagged."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    t = c.withColumn("total", F.sum("n").over(Window.partitionBy("n_regionkey")))
    how = F.col("n_nationkey") % 3
    s = suppressed(half_up(F.col("n") * 100.0 / F.col("total"), 2), F.when(how == 0, F.col("n")), (how == 2) & (F.col("n_regionkey") == 4), F.when(how == 1, F.col("total")), F.col("n_regionkey") < 3)
    return t.select(F.col("n_name").alias("label"), *[v.alias(k) for k, v in s.items()])


@query("""WITH c AS (SELECT event_id, event_type, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, row_number() OVER (PARTITION BY CAST(ts + INTERVAL 330 MINUTE AS DATE), event_type ORDER BY ts, event_id) AS of_kind FROM events), k AS (SELECT * FROM c WHERE event_type <> 'signup' OR of_kind <= 20)
SELECT day, count(*) FILTER (event_type = 'signup') AS searches, least(count(*), 250) AS total, count(*) > 250 AS exhausted FROM k GROUP BY day""")
def daily_budget_totals(spark: SparkSession, d: str) -> DataFrame:
    """Calls charged on each day at UTC+5:30: searches up to twenty, all together up to a total.

    Which calls pass need not be known for the numbers, so plain counts by day and
    kind are enough.
    """
    n = table(spark, d, "events").groupBy(F.to_date(ist(F.col("ts"))).alias("day"), "event_type").agg(F.count("*").alias("n"))
    passed = F.when(F.col("event_type") == "signup", F.least("n", F.lit(20))).otherwise(F.col("n"))
    g = n.groupBy("day").agg(F.sum(F.when(F.col("event_type") == "signup", passed).otherwise(0)).alias("searches"), F.sum(passed).alias("all"))
    return g.select("day", "searches", F.least("all", F.lit(250)).alias("total"), (F.col("all") > 250).alias("exhausted"))


@query(f"WITH {POSTS} SELECT post_id, CASE WHEN sentiment_confidence >= 0.5 THEN has_risk ELSE true END AS relevant, CASE WHEN sentiment_confidence >= 0.5 AND has_risk IS NOT NULL THEN 'model' ELSE 'query_fallback' END AS classifier, CASE WHEN sentiment_confidence >= 0.5 AND has_risk IS NOT NULL THEN 'said so' ELSE 'Found via ' || source || '; review unavailable.' END AS reason FROM p WHERE source IS NOT NULL AND (sentiment_confidence < 0.5 OR sentiment_confidence IS NULL OR has_risk IS NOT NULL)")
def relevance_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Judgements where an answer came; without one a candidate stays relevant and says how it was found."""
    p = posts(spark, d).filter("source is not null and (sentiment_confidence < 0.5 or sentiment_confidence is null or has_risk is not null)")
    came = F.coalesce((F.col("sentiment_confidence") >= 0.5) & F.col("has_risk").isNotNull(), F.lit(False))
    return p.select("post_id", F.when(came, F.col("has_risk")).otherwise(True).alias("relevant"), F.when(came, "model").otherwise("query_fallback").alias("classifier"), F.when(came, "said so").otherwise(F.concat(F.lit("Found via "), "source", F.lit("; review unavailable."))).alias("reason"))


@query("SELECT user_id, string_agg(DISTINCT event_type, ' ' ORDER BY event_type) AS kept FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY user_id")
def except_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of each user less a fixed set."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return g.select("user_id", F.array_join(F.array_sort(F.array_except("k", F.array(F.lit("error"), F.lit("signup")))), " ").alias("kept")).filter("kept <> ''")


@query("SELECT video_id, epoch_us(observed_at) AS at_us, view_count AS views, like_count AS likes FROM video_metric_snapshots WHERE view_count BETWEEN 0 AND 9007199254740991")
def counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters that are safe whole numbers; others are null, and rows without views are out."""
    s = table(spark, d, "video_metric_snapshots")
    return s.select("video_id", F.unix_micros("observed_at").alias("at_us"), safe_count(F.col("view_count")).alias("views"), safe_count(F.col("like_count")).alias("likes")).filter("views is not null")


@query(f"WITH {POSTS} SELECT post_id, array_to_string(list_slice(list_sort(list_distinct(list_filter(regexp_extract_all(lower(original_text), '[a-z]+'), lambda x: length(x) > 3))), 1, 12), ' ') AS terms FROM p WHERE original_text IS NOT NULL")
def first_terms(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve distinct words of a post in alphabetical order."""
    w = F.filter(F.regexp_extract_all(F.lower("original_text"), F.lit("[a-z]+"), F.lit(0)), lambda x: F.length(x) > 3)
    return posts(spark, d).filter("original_text is not null").select("post_id", F.array_join(F.slice(F.array_sort(F.array_distinct(w)), 1, 12), " ").alias("terms"))
