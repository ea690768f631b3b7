"""Suppressed audience tables, evaluation and moderation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions.math import half_up
from quillmark.plans.base import POSTS, posts, query
from quillmark.sources.tables import table


def segments(df: DataFrame, dims: list[str], confidence: str, least: int) -> DataFrame:
    """Groups of each dimension with at least ``least`` rows; percents are of all classified rows, hidden ones included."""
    long = df.unpivot([confidence], dims, "dimension", "value").filter("value is not null")
    g = long.groupBy("dimension", "value").agg(F.count("*").alias("n"), F.avg(confidence).alias("mean"))
    g = g.withColumn("total", F.sum("n").over(Window.partitionBy("dimension")))
    return g.filter(F.col("n") >= least).select("dimension", "value", "n", half_up(F.lit(100.0) * F.col("n") / F.col("total"), 1).alias("percent"), F.round("mean", 6).alias("mean"))


_SEG = """WITH l AS (SELECT 'segment' AS dimension, c_mktsegment AS value, c_acctbal AS x FROM customer UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), c_acctbal FROM customer), g AS (SELECT dimension, value, count(*) AS n, avg(x) AS m FROM l WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY dimension) AS total FROM g)
SELECT dimension, value, n, floor(100.0::DOUBLE * n / total * 10 + 0.5) / 10.0 AS percent, round(m, 6) AS mean FROM t WHERE n >= {0}"""


def _audience(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_acctbal", F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").cast("string").alias("nation"))


@query(_SEG.format(60))
def audience_share_k60(spark: SparkSession, d: str) -> DataFrame:
    """Groups of each dimension with sixty members or more; percents are of all rows."""
    return segments(_audience(spark, d), ["segment", "nation"], "c_acctbal", 60)


@query("""WITH c AS (SELECT n_name AS label, c_mktsegment AS dimension, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY dimension) AS total FROM c) SELECT dimension, label, CASE WHEN n < 10 THEN NULL ELSE floor(n * 100.0::DOUBLE / total * 100 + 0.5) / 100.0 END AS percent, n < 10 AS suppressed FROM t""")
def demographic_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Percents are withheld where the count is below ten."""
    g = table(spark, d, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("dimension")).agg(F.count("*").alias("n"))
    g = g.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).withColumn("total", F.sum("n").over(Window.partitionBy("dimension")))
    return g.select("dimension", F.col("n_name").alias("label"), F.when(F.col("n") >= 10, half_up(F.col("n") * 100.0 / F.col("total"), 2)).alias("percent"), (F.col("n") < 10).alias("suppressed"))


def verdict(score: Column, english: Column, threat: Column) -> Column:
    """Verdict ladder of a moderation score; a threat lifts it to severe."""
    s = F.when(threat, F.greatest(score, F.lit(0.85))).otherwise(score)
    return F.when(s.isNull(), "unavailable").when(s >= 0.85, "severe").when(~english & (s >= 0.25) & (s < 0.4), "unsure").when(s < 0.4, "clean").otherwise("rude")


def _re(pattern: str) -> str:
    """The same test in SQL; quotes doubled."""
    return "regexp_matches(t, '(?i)" + pattern.replace("'", "''") + "')"


_HINT = f"""h AS (SELECT post_id, english, s, t, CASE WHEN ({_re(T.THREAT_DIRECT)} OR {_re(T.THREAT_SHORT)} OR {_re(T.THREAT_INDIC)}) AND NOT ({_re(T.THREAT_QUOTED)} OR {_re(T.THREAT_NEGATED)}) THEN 'threat' WHEN {_re(T.CHECK_WORDS[0])} OR {_re(T.CHECK_WORDS[1])} THEN 'check' END AS hint FROM (
SELECT post_id, coalesce(primary_lang, 'und') = 'en' AS english, aggression_score AS s, regexp_replace(regexp_replace(original_text, '[\u2019\u2018]', chr(39), 'g'), '[\u200b-\u200d\ufeff]', '', 'g') AS t FROM p))"""


@query(f"WITH {POSTS}, {_HINT} SELECT post_id, hint FROM h WHERE hint IS NOT NULL")
def threat_hints(spark: SparkSession, d: str) -> DataFrame:
    """Posts that read as a threat, or as hostile."""
    return posts(spark, d).select("post_id", T.threat_hint(F.col("original_text")).alias("hint")).filter("hint is not null")


@query(f"""WITH {POSTS}, {_HINT}, v AS (SELECT post_id, english, CASE WHEN hint = 'threat' THEN greatest(s, 0.85) ELSE s END AS s FROM h)
SELECT post_id, CASE WHEN s IS NULL THEN 'unavailable' WHEN s >= 0.85 THEN 'severe' WHEN NOT english AND s >= 0.25 AND s < 0.4 THEN 'unsure' WHEN s < 0.4 THEN 'clean' ELSE 'rude' END AS verdict FROM v""")
def moderation_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the score, lifted to severe by a threat in the text; no score, no verdict."""
    threat = F.coalesce(F.col("aggression_score").isNotNull() & (T.threat_hint(F.col("original_text")) == "threat"), F.lit(False))
    return posts(spark, d).select("post_id", verdict(F.col("aggression_score"), F.coalesce("primary_lang", F.lit("und")) == "en", threat).alias("verdict"))


_TRUTH = f"""WITH {POSTS}, x AS (SELECT p.sentiment_label AS said, CASE WHEN p.event_polarity = 'negative' THEN 'negative' WHEN p.event_polarity = 'positive' THEN 'positive' ELSE 'neutral' END AS truth, p.sentiment_confidence AS conf FROM p WHERE p.sentiment_label IN ('positive', 'neutral', 'negative'))"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    truth = F.when(F.col("event_polarity") == "negative", "negative").when(F.col("event_polarity") == "positive", "positive").otherwise("neutral")
    return posts(spark, d).filter(F.col("sentiment_label").isin("positive", "neutral", "negative")).select(F.col("sentiment_label").alias("said"), truth.alias("truth"), F.col("sentiment_confidence").alias("conf"))


@query(_TRUTH + """, k AS (SELECT unnest(['positive', 'neutral', 'negative']) AS class), c AS (SELECT class, count(*) FILTER (said = class AND truth = class) AS tp, count(*) FILTER (said = class) AS said_n, count(*) FILTER (truth = class) AS true_n FROM k, x GROUP BY class)
SELECT class, round(coalesce(tp / nullif(CAST(said_n AS DOUBLE), 0), 0), 6) AS "precision", round(coalesce(tp / nullif(CAST(true_n AS DOUBLE), 0), 0), 6) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(said_n + true_n, 0), 0), 6) AS f1 FROM c""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of each class from one confusion matrix."""
    hit = F.col("said") == F.col("truth")
    sides = F.array(F.struct(F.col("said").alias("class"), hit.cast("int").alias("tp"), F.lit(1).alias("s"), F.lit(0).alias("t")), F.struct(F.col("truth").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("s"), F.lit(1).alias("t")))
    n = _judged(spark, d).select(F.explode(sides).alias("x")).groupBy("x.class").agg(*[F.sum(f"x.{k}").alias(k) for k in ("tp", "s", "t")])
    classes = spark.createDataFrame([("positive",), ("neutral",), ("negative",)], "class string")
    c = classes.join(n, "class", "left").fillna(0, ["tp", "s", "t"])
    ratio = lambda a, b: F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)
    return c.select("class", ratio(F.col("tp"), F.col("s")).alias("precision"), ratio(F.col("tp"), F.col("t")).alias("recall"), ratio(2 * F.col("tp"), F.col("s") + F.col("t")).alias("f1"))


@query(_TRUTH + """ SELECT CAST(least(floor(conf * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(CASE WHEN said = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy, round(avg(conf), 6) AS mean_confidence FROM x WHERE conf IS NOT NULL GROUP BY 1""")
def calibration_bins(spark: SparkSession, d: str) -> DataFrame:
    x = _judged(spark, d).filter("conf is not null")
    return x.groupBy(F.least(F.floor(F.col("conf") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("said") == F.col("truth")).cast("double")), 6).alias("accuracy"), F.round(F.avg("conf"), 6).alias("mean_confidence"))
