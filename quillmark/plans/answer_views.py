"""Answers of models as text: salvage, cleaning, validation against the text they speak of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import answers as A
from quillmark.plans.base import POSTS, posts, query


@query(f"""WITH {POSTS} SELECT post_id, post_id AS id, sentiment_label AS label, greatest(-1::DOUBLE, least(1::DOUBLE, coalesce(2 * sentiment_score, 0))) AS score, CASE WHEN has_risk THEN '' ELSE 'anger' END AS emotions FROM p WHERE sentiment_label IN ('positive', 'negative', 'neutral')""")
def salvaged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Answers read from fenced, chatty, unquoted and cut-off JSON; unknown labels are dropped, scores kept in bounds."""
    p = posts(spark, d).select("post_id", "has_risk", "sentiment_label", F.coalesce((2 * F.col("sentiment_score")).cast("string"), F.lit("null")).alias("s"))
    label = F.coalesce("sentiment_label", F.lit("none"))
    whole = F.concat(F.lit('Sure!\n```json\n[{"id":"'), "post_id", F.lit('","label":" '), F.upper(label), F.lit('","score":'), "s", F.lit(',"emotions":["Anger","pride"]}]\n```\nthanks'))
    broken = F.concat(F.lit('[{"id":"'), "post_id", F.lit('","label": '), label, F.lit(', "score": '), "s", F.lit('},{"id":"cut", "label": "neg'))
    r = p.select("post_id", F.when(F.coalesce("has_risk", F.lit(False)), broken).otherwise(whole).alias("reply"))
    return A.cleaned(A.items(r, "post_id", "reply")).select("post_id", "id", "label", "score", F.array_join(F.coalesce("emotions", F.array().cast("array<string>")), " ").alias("emotions"))


_FP = A.FIRST_PERSON.replace("'", "''")


@query(f"""WITH {POSTS}, e AS (SELECT post_id, original_text AS t, trim(regexp_extract(original_text, '(?i)(?:^|\\s)(?:my|we|i|our|nous|the) \\S+ \\S+')) AS e, CASE source WHEN 'x' THEN 'student' WHEN 'youtube' THEN 'working' WHEN 'telegram' THEN 'nobody' ELSE 'fan_viewer' END AS s, sentiment_confidence AS c FROM p WHERE original_text IS NOT NULL),
v AS (SELECT *, coalesce(s IN ({', '.join(repr(x) for x in A.SEGMENTS)}) AND length(e) BETWEEN 1 AND 80 AND contains(lower(t), lower(e)) AND (length(t) <= 30 OR length(e) <= length(t) * 0.7) AND (regexp_matches(e, '(?i)(^|[^\\p{{L}}])({_FP})([^\\p{{L}}]|$)') OR regexp_matches(e, '{A.FIRST_PERSON_INDIC}')) AND c BETWEEN 0.6 AND 1, false) AS ok FROM e)
SELECT post_id, CASE WHEN ok THEN s ELSE 'unstated' END AS segment, CASE WHEN ok THEN e END AS evidence, CASE WHEN ok THEN floor(c * 100 + 0.5) / 100 END AS confidence FROM v""")
def segment_validation(spark: SparkSession, d: str) -> DataFrame:
    """Claimed segments that hold only where a short first-person phrase of the text says so."""
    t = F.col("original_text")
    e = F.trim(F.regexp_extract(t, r"(?i)(?:^|\s)(?:my|we|i|our|nous|the) \S+ \S+", 0))
    s = F.when(F.col("source") == "x", "student").when(F.col("source") == "youtube", "working").when(F.col("source") == "telegram", "nobody").otherwise("fan_viewer")
    v = posts(spark, d).filter("original_text is not null").select("post_id", A.valid_segment(t, s, e, F.col("sentiment_confidence")).alias("v"))
    return v.select("post_id", F.col("v.id").alias("segment"), "v.evidence", "v.confidence")


@query(f"""WITH {POSTS}, r AS (SELECT post_id, sentiment_confidence AS c, CASE WHEN aggression_score < 0.1 THEN '18-24' WHEN aggression_score < 0.2 THEN '25-34' ELSE 'old' END AS age, CASE WHEN has_risk THEN 'male' ELSE 'unclear' END AS gender, CASE primary_lang WHEN 'ta' THEN ' in' WHEN 'hi' THEN 'IN' ELSE 'Europe' END AS region, CASE primary_lang WHEN 'ta' THEN 'tamil nadu ' ELSE 'Atlantis' END AS state FROM p)
SELECT post_id, CASE WHEN ok AND age <> 'old' THEN age END AS age, CASE WHEN ok AND gender = 'male' THEN gender END AS gender, CASE WHEN ok AND region <> 'Europe' THEN 'IN' END AS region, CASE WHEN ok AND state = 'tamil nadu ' THEN 'Tamil Nadu' END AS state, CASE WHEN ok THEN floor(c * 100 + 0.5) / 100 END AS confidence FROM (SELECT *, coalesce(c BETWEEN 0.4 AND 1, false) AS ok FROM r)""")
def estimate_validation(spark: SparkSession, d: str) -> DataFrame:
    """Estimates with allowed values only, regions as codes, states within their country."""
    p = posts(spark, d)
    a = F.col("aggression_score")
    age = F.when(a < 0.1, "18-24").when(a < 0.2, "25-34").otherwise("old")
    region = F.when(F.col("primary_lang") == "ta", " in").when(F.col("primary_lang") == "hi", "IN").otherwise("Europe")
    state = F.when(F.col("primary_lang") == "ta", "tamil nadu ").otherwise("Atlantis")
    v = p.select("post_id", A.valid_estimate(age, F.when(F.col("has_risk"), "male").otherwise("unclear"), region, state, F.col("sentiment_confidence")).alias("v"))
    return v.select("post_id", "v.*")


@query(f"""WITH {POSTS}, r AS (SELECT post_id, original_text AS t, trim(regexp_extract(original_text, '\\S+ \\S+')) AS g, CASE WHEN has_risk THEN 'nothing of the text' ELSE upper(trim(regexp_extract(original_text, '\\S+ \\S+'))) END AS target, CASE sentiment_label WHEN 'positive' THEN 'supportive' WHEN 'negative' THEN 'opposed' ELSE 'neutral' END AS stance FROM p WHERE original_text IS NOT NULL),
q AS (SELECT *, CASE WHEN length(target) > 0 AND contains(lower(t), lower(target)) THEN left(target, 150) END AS quoted FROM r) SELECT post_id, 'hope' AS emotions, quoted AS target, CASE WHEN quoted IS NOT NULL AND stance IN ('supportive', 'opposed') THEN stance ELSE 'unclear' END AS stance FROM q""")
def stance_validation(spark: SparkSession, d: str) -> DataFrame:
    """Stances hold only towards a target that the text quotes."""
    t = F.col("original_text")
    two = F.upper(F.trim(F.regexp_extract(t, r"\S+ \S+", 0)))
    stance = F.when(F.col("sentiment_label") == "positive", "supportive").when(F.col("sentiment_label") == "negative", "opposed").otherwise("neutral")
    v = posts(spark, d).filter("original_text is not null").select("post_id", A.valid_stance(t, F.array(F.lit("hope"), F.lit("hope"), F.lit("pride")), F.when(F.col("has_risk"), "nothing of the text").otherwise(two), stance).alias("v"))
    return v.select("post_id", F.array_join("v.emotions", " ").alias("emotions"), "v.target", "v.stance")
