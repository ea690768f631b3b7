"""Language ladder, first passes, escalation, merges of answers, suppressed audience totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import decisions as D
from quillmark.functions import text as T
from quillmark.functions.math import half_up
from quillmark.plans.base import POSTS, posts, query
from quillmark.sources.tables import table

_INFO = "l AS (SELECT post_id, primary_lang AS lang, lang_confidence AS sure, is_code_mixed AS mixed, candidates FROM language_info), k AS (SELECT post_id, has_risk AS risk FROM risk_signals)"
_BASE = f"{POSTS}, {_INFO}, b AS (SELECT p.post_id, p.original_text AS t, p.sentiment_label, p.sentiment_score, p.sentiment_confidence, p.is_duplicate, lang, sure, mixed, candidates, risk FROM p LEFT JOIN l USING (post_id) LEFT JOIN k USING (post_id) WHERE p.original_text IS NOT NULL)"


def _base(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "language_info").select("post_id", F.col("primary_lang").alias("lang"), F.col("lang_confidence").alias("sure"), F.col("is_code_mixed").alias("mixed"), "candidates")
    risk = table(spark, d, "risk_signals").select("post_id", F.col("has_risk").alias("risk"))
    p = posts(spark, d).filter("original_text is not null").select("post_id", F.col("original_text").alias("t"), "sentiment_label", "sentiment_score", "sentiment_confidence", "is_duplicate")
    return p.join(info, "post_id", "left").join(risk, "post_id", "left")


_N = {s: f"(length(a) - length(regexp_replace(a, '\\p{{{s}}}', '', 'g')))" for s in D.SCRIPTS}
_FUNC, _ONLY = (", ".join(f"'{w}'" for w in ws) for ws in (T.FUNCTION_WORDS, T.DISTINCTIVE))
_LANG = f"""s0 AS (SELECT post_id, trim(t) AS t, regexp_replace(t, '\\P{{L}}', '', 'g') AS a, candidates[1].lang AS guess, coalesce(candidates[1].confidence, 0) AS sure, list_transform(regexp_extract_all(lower(t), '[a-z'']+'), lambda x: trim(x, chr(39))) AS r FROM b),
s1 AS (SELECT *, length(a) AS letters, length(a) - length(regexp_replace(a, '\\p{{Latin}}', '', 'g')) AS latin, greatest({', '.join(_N.values())}) AS most, CASE {' '.join(f"WHEN {n} = greatest({', '.join(_N.values())}) THEN '{D.SCRIPTS[s]}'" for s, n in _N.items())} END AS of_script, list_filter(r, lambda x: x <> '') AS ws FROM s0),
s2 AS (SELECT *, most / nullif(letters::DOUBLE, 0) AS share, list_filter(list_transform(ws, lambda x: CASE WHEN x IN ({_FUNC}) THEN x WHEN contains(x, chr(39)) AND split_part(x, chr(39), 1) IN ({_FUNC}) THEN split_part(x, chr(39), 1) END), lambda x: x IS NOT NULL) AS hit,
len(list_distinct(list_filter(list_concat(r, list_transform(list_filter(r, lambda x: contains(x, chr(39))), lambda x: split_part(x, chr(39), 1))), lambda x: x IN ({_ONLY})))) AS eng FROM s1),
s3 AS (SELECT *, length(t) < 8 AS fragment, length(t) >= 8 AND share >= 0.5 AS by_script, guess IS NULL OR sure <= 0 AS none, coalesce(((guess = 'en' AND ((len(list_distinct(hit)) >= 2 AND len(hit) / nullif(len(ws)::DOUBLE, 0) >= 0.18) OR (len(list_distinct(hit)) >= 1 AND len(ws) <= 8))) OR eng >= 2) AND most = 0, false) AS rescued FROM s2)"""


@query(f"""WITH {_BASE}, {_LANG} SELECT post_id, CASE WHEN letters = 0 THEN 'und' WHEN fragment THEN CASE WHEN eng >= 1 AND latin > 0 AND most = 0 THEN 'en' ELSE 'und' END WHEN by_script THEN of_script WHEN none THEN 'und' WHEN rescued THEN 'en' ELSE guess END AS primary_lang,
CASE WHEN letters = 0 THEN 0 WHEN fragment THEN CASE WHEN eng >= 1 AND latin > 0 AND most = 0 THEN 0.6::DOUBLE ELSE 0 END WHEN by_script THEN round(least(0.99::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * share), 4) WHEN none THEN 0 WHEN rescued THEN greatest(sure, 0.8::DOUBLE) ELSE sure END AS lang_confidence,
coalesce(CASE WHEN letters = 0 OR fragment THEN false WHEN by_script THEN share < 0.9 AND latin > 2 WHEN none OR rescued THEN false ELSE (guess <> 'en' AND sure < 0.7 AND latin > 0) OR (latin > 2 AND most > 0) END, false) AS is_code_mixed FROM s3""")
def language_detect(spark: SparkSession, d: str) -> DataFrame:
    """Language ladder over scripts, a detector's stored guess and the rescue of English."""
    first = F.get("candidates", F.lit(0))
    return _base(spark, d).select("post_id", *[c.alias(k) for k, c in D.detected_language(F.col("t"), first["lang"], first["confidence"]).items()])


_EMPTY = f"length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'), '@[A-Za-z0-9_]{{2,30}}\\b', ' ', 'g'), '{T.EMOJI}', ' ', 'g'), '^[ \\t\\n#@:;,.!?_-]+', '')) = 0"
_MARKERS = " OR ".join(f"contains(lower(t), '{m}')" for m in T.SARCASM) + f" OR (regexp_matches(t, '[{T.SOUR_FACES}]') AND regexp_matches(lower(t), '\\b({T.SWEET_WORDS})\\b'))"
_ENGLISH = "coalesce(lang, 'und') = 'en' AND NOT coalesce(mixed, false)"
_LEX = f"""w AS (SELECT *, {_ENGLISH} AS english, {_EMPTY} OR trim(t) = '' AS empty, list_distinct(regexp_extract_all(lower(t), '[a-z]+')) AS ws FROM b),
n AS (SELECT *, len(list_filter(ws, lambda x: x IN ({', '.join(repr(x) for x in D.POSITIVE_WORDS)}))) AS p, len(list_filter(ws, lambda x: x IN ({', '.join(repr(x) for x in D.NEGATIVE_WORDS)}))) AS q FROM w),
c AS (SELECT *, (p - q) / greatest(p + q, 1)::DOUBLE AS compound, coalesce(p / nullif(len(ws)::DOUBLE, 0), 0) AS pos, coalesce(q / nullif(len(ws)::DOUBLE, 0), 0) AS neg FROM n),
f AS (SELECT *, list_sort(list_filter([CASE WHEN english AND p + q = 0 THEN 'no_lexicon_match' END, CASE WHEN english AND p + q > 0 AND abs(compound) < 0.45 THEN 'weak_signal' END, CASE WHEN english AND pos > 0.3 AND neg > 0.3 THEN 'mixed_polarity' END,
CASE WHEN NOT english AND coalesce(lang, 'und') NOT IN ('en', 'und') THEN 'non_english' END, CASE WHEN (NOT english AND coalesce(lang, 'und') = 'und') OR (english AND coalesce(sure, 0) < 0.7) THEN 'low_language_conf' END, CASE WHEN mixed THEN 'code_mixed' END, CASE WHEN {_MARKERS} THEN 'sarcasm_marker' END, CASE WHEN risk THEN 'risk_signals' END, CASE WHEN contains(t, '?') THEN 'question' END], lambda x: x IS NOT NULL)) AS found, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) < 2 AS short FROM c)"""


def _lexicon(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    b = _base(spark, d)
    return b, D.first_pass_lexicon(F.col("t"), D.lexicon_scores(F.col("t")), F.col("lang"), F.col("sure"), F.col("mixed"), F.col("risk"))


@query(f"""WITH {_BASE}, {_LEX} SELECT post_id, CASE WHEN empty OR NOT english THEN 'unavailable' WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label, round(CASE WHEN empty OR NOT english THEN 0 ELSE compound END, 6) AS score, CASE WHEN empty THEN 'skipped_empty' WHEN english THEN 'vader' ELSE 'unavailable' END AS source, CASE WHEN empty OR short THEN '' ELSE array_to_string(found, ' ') END AS reasons FROM f""")
def first_pass_lexicon(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the lexicon tier with all nine reasons to escalate."""
    b, r = _lexicon(spark, d)
    return b.select("post_id", r["label"].alias("label"), F.round(r["score"], 6).alias("score"), r["source"].alias("source"), F.array_join(r["reasons"], " ").alias("reasons"))


_MODEL = f"""m AS (SELECT *, {_ENGLISH} AS english, {_EMPTY} AS empty FROM b), g AS (SELECT *, list_sort(list_filter([CASE WHEN english AND sentiment_confidence < 0.6 THEN 'low_model_confidence' END, CASE WHEN NOT english AND coalesce(lang, 'und') NOT IN ('en', 'und') THEN 'non_english' END, CASE WHEN (NOT english AND coalesce(lang, 'und') = 'und') OR (english AND coalesce(sure, 0) < 0.7) THEN 'low_language_conf' END, CASE WHEN mixed THEN 'code_mixed' END, CASE WHEN risk THEN 'risk_signals' END], lambda x: x IS NOT NULL)) AS found FROM m)"""


def _model(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    b = _base(spark, d)
    c = [F.col(x) for x in ("t", "sentiment_label", "sentiment_score", "sentiment_confidence", "lang", "sure", "mixed", "risk")]
    return b, D.first_pass_model(*c)


@query(f"""WITH {_BASE}, {_MODEL} SELECT post_id, CASE WHEN empty OR NOT english THEN 'unavailable' WHEN sentiment_label IN ('positive', 'negative', 'neutral') THEN sentiment_label ELSE 'neutral' END AS label, CASE WHEN empty THEN 'skipped_empty' WHEN english THEN 'transformer' ELSE 'unavailable' END AS source, CASE WHEN empty THEN '' ELSE array_to_string(found, ' ') END AS reasons FROM g""")
def first_pass_model(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the model tier with its five reasons to escalate."""
    b, r = _model(spark, d)
    return b.select("post_id", *[r[k].alias(k) for k in ("label", "source")], F.array_join(r["reasons"], " ").alias("reasons"))


@query(f"""WITH {_BASE}, {_MODEL}, x AS (SELECT is_duplicate, CASE WHEN empty THEN 'skipped_empty' WHEN english THEN 'transformer' ELSE 'unavailable' END AS source, CASE WHEN empty THEN [] ELSE found END AS found FROM g)
SELECT 'reason' AS kind, r AS name, count(*) AS posts FROM (SELECT unnest(found) AS r FROM x) GROUP BY r UNION ALL SELECT 'source', source, count(*) FROM x GROUP BY source UNION ALL SELECT 'total', 'escalated', count(*) FILTER (len(found) > 0) FROM x UNION ALL SELECT 'total', 'posts', count(*) FROM x UNION ALL SELECT 'total', 'duplicates', count(*) FILTER (is_duplicate) FROM x
UNION ALL SELECT 'rate', 'per_mille', CAST(floor(1000.0 * count(*) FILTER (len(found) > 0) / count(*) + 0.5) AS BIGINT) FROM x""")
def escalation_report(spark: SparkSession, d: str) -> DataFrame:
    """How many posts are escalated and why, their sources and duplicates; one pass over the posts.

    Every post is exploded to the few names it counts for, so there is one
    aggregation with partial sums.
    """
    b, r = _model(spark, d)
    name = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("name"))
    x = b.select("is_duplicate", r["source"].alias("source"), r["reasons"].alias("reasons"))
    total = lambda when, n: F.when(when, name("total", F.lit(n)))
    names = F.array_compact(F.concat(F.transform("reasons", lambda q: name("reason", q)), F.array(name("source", F.col("source")), name("total", F.lit("posts")), total(F.size("reasons") > 0, "escalated"), total(F.col("is_duplicate"), "duplicates"))))
    n = x.select(F.explode(names).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("posts"))
    count = lambda k: F.coalesce(F.sum(F.when((F.col("kind") == "total") & (F.col("name") == k), F.col("posts"))), F.lit(0))
    rate = n.agg(F.lit("rate").alias("kind"), F.lit("per_mille").alias("name"), F.floor(F.try_divide(1000.0 * count("escalated"), count("posts")) + 0.5).alias("posts"))
    zeros = x.sparkSession.createDataFrame([("total", k) for k in ("posts", "escalated", "duplicates")], "kind string, name string")
    missing = zeros.join(n, ["kind", "name"], "left_anti").select("kind", "name", F.lit(0).cast("bigint").alias("posts"))
    return n.unionByName(missing).unionByName(rate)


@query(f"""WITH {_BASE}, {_LEX}, a AS (SELECT post_id, sentiment_label AS l, greatest(-1, least(1, 2 * sentiment_score)) AS s FROM b WHERE sentiment_label IN ('positive', 'negative', 'neutral') AND sentiment_confidence >= 0.5),
j AS (SELECT f.*, a.l, a.s, CASE WHEN empty OR short THEN false ELSE len(found) > 0 END AS asked, CASE WHEN empty THEN 'skipped_empty' WHEN english THEN 'vader' ELSE 'unavailable' END AS src, CASE WHEN empty OR NOT english THEN 'unavailable' WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS lab FROM f LEFT JOIN a USING (post_id))
SELECT post_id, CASE WHEN asked AND l IS NOT NULL THEN l WHEN asked AND src <> 'vader' THEN 'unavailable' ELSE lab END AS label, CASE WHEN asked AND l IS NOT NULL THEN 'minimax' WHEN asked AND src = 'vader' THEN 'vader_llm_failed' WHEN asked THEN 'unavailable' ELSE src END AS source,
CASE WHEN asked AND l IS NOT NULL THEN round(least(1.0::DOUBLE, 0.6::DOUBLE + 0.4::DOUBLE * abs(s)), 4) WHEN asked AND src <> 'vader' THEN 0 WHEN empty OR NOT english THEN 0 ELSE round(least(1.0::DOUBLE, abs(compound)), 4) END AS confidence FROM j""")
def merged_answers(spark: SparkSession, d: str) -> DataFrame:
    """First passes with the answers that came for them; answers for unknown or unasked posts change nothing."""
    b, first = _lexicon(spark, d)
    s = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 2 * F.col("sentiment_score")))
    came = F.col("sentiment_label").isin(*D.LABELS) & (F.col("sentiment_confidence") >= 0.5)
    answers = b.filter(came).select("post_id", F.col("sentiment_label").alias("al"), s.alias("asc"))
    f = b.select("post_id", *[c.alias(k) for k, c in first.items()])
    j = f.join(answers, "post_id", "left")
    m = D.merged_answer({k: F.col(k) for k in first}, F.col("al").isNotNull(), F.col("al"), F.col("asc"))
    return j.select("post_id", *[m[k].alias(k) for k in ("label", "source", "confidence")])


@query(f"""WITH {POSTS}, w AS (SELECT post_id, original_text AS t, list_distinct(regexp_extract_all(lower(original_text), '[a-z]+')) AS ws FROM p WHERE original_text IS NOT NULL), n AS (SELECT *, len(list_filter(ws, lambda x: x IN ({', '.join(repr(x) for x in D.POSITIVE_WORDS)}))) AS p, len(list_filter(ws, lambda x: x IN ({', '.join(repr(x) for x in D.NEGATIVE_WORDS)}))) AS q FROM w),
s AS (SELECT *, (p - q) / greatest(p + q, 1)::DOUBLE AS score, coalesce(list_max(list_filter([{', '.join(f"CASE WHEN contains(lower(t), '{t}') THEN {w}::DOUBLE END" for t, w in D.EVENT_WEIGHTS.items())}], lambda x: x IS NOT NULL)), 0) AS sev FROM n)
SELECT post_id, CASE WHEN score > 0.15 THEN 'positive' WHEN score < -0.15 THEN 'negative' ELSE 'neutral' END AS label, round(score, 3) AS score, CASE WHEN sev >= 0.5 THEN 'negative' ELSE 'neutral' END AS event, sev AS severity, CASE {' '.join(f"WHEN regexp_matches(lower(t), '{w}') THEN '{n}'" for n, w in D.TOPIC_WORDS.items())} ELSE 'Other civic discussion' END AS topic FROM s""")
def heuristic_preview(spark: SparkSession, d: str) -> DataFrame:
    """Preview by word lists: sentiment, event severity, keyword topic."""
    t = F.col("original_text")
    s = D.lexicon_scores(t)["compound"]
    event, severity = D.heuristic_event(t)
    return posts(spark, d).filter("original_text is not null").select("post_id", D.heuristic_label(s).alias("label"), F.round(s, 3).alias("score"), event.alias("event"), severity.alias("severity"), D.keyword_topic(t).alias("topic"))


def segment_groups(df: DataFrame, segment: str, confidence: str, least: int = 3) -> DataFrame:
    """Shown groups of self-described segments: count, percent of all classified, mean confidence, place.

    A null segment is pending and ``unstated`` is no group; groups below ``least``
    are hidden but count in the percent's base.
    """
    g = df.filter((F.col(segment) != "unstated")).groupBy(F.col(segment).alias("segment")).agg(F.count("*").alias("n"), F.sum(confidence).alias("total"))
    g = g.withColumn("all", F.sum("n").over(Window.partitionBy()))  # one row for each segment
    shown = g.filter(F.col("n") >= least)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "segment"))
    return shown.select("segment", "n", half_up(F.col("n") / F.col("all") * 100, 1).alias("percent"), half_up(F.col("total") / F.col("n"), 2).alias("confidence"), place.alias("place"))


def segment_totals(df: DataFrame, segment: str, least: int = 3) -> DataFrame:
    """One row: estimated, pending, classified, unstated, and the number of hidden groups."""
    per = df.groupBy(F.col(segment).alias("s")).agg(F.count("*").alias("n"))
    named = F.col("s").isNotNull() & (F.col("s") != "unstated")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return per.agg(part(F.col("s").isNotNull()).alias("estimated"), part(F.col("s").isNull()).alias("pending"), part(named).alias("classified"), part(F.col("s") == "unstated").alias("unstated"), F.count_if(named & (F.col("n") < least)).alias("hidden_groups"))


def estimate_groups(df: DataFrame, dims: list[str], known: str, least: int = 2, order: dict[str, list[str]] | None = None) -> DataFrame:
    """Shown values of each dimension: count, percent of those with a value, place.

    Values of a dimension named in ``order`` are placed in that order, others by
    count.
    """
    long = df.filter(known).unpivot([], dims, "dimension", "value").filter("value is not null")
    g = long.groupBy("dimension", "value").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("dimension")))
    rank = F.lit(0)
    for dim, values in (order or {}).items():
        rank = F.when(F.col("dimension") == dim, F.array_position(F.array(*map(F.lit, values)), F.col("value"))).otherwise(rank)
    w = Window.partitionBy("dimension").orderBy(rank, F.desc("n"), "value")
    return g.filter(F.col("n") >= least).select("dimension", "value", "n", half_up(F.col("n") / F.col("total") * 100, 1).alias("percent"), F.row_number().over(w).alias("place"))


def estimate_totals(df: DataFrame, dims: list[str], known: str, stale: str, confidence: str, least: int = 2) -> DataFrame:
    """For each dimension: total with a value, unclear, hidden values; and over all: estimated, pending, stale, mean confidence."""
    k = F.expr(known)
    all_ = df.agg(F.count("*").alias("rows"), F.count_if(k).alias("estimated"), F.count_if(k & F.expr(stale)).alias("stale"), half_up(F.avg(F.when(k, F.col(confidence))), 2).alias("confidence"))
    g = df.filter(k).unpivot([], dims, "dimension", "value").groupBy("dimension", "value").agg(F.count("*").alias("n"))
    per = g.groupBy("dimension").agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("total"), F.count_if(F.col("value").isNotNull() & (F.col("n") < least)).alias("hidden"))
    return per.crossJoin(F.broadcast(all_)).select("dimension", "total", (F.col("estimated") - F.col("total")).alias("unclear"), "hidden", "estimated", (F.col("rows") - F.col("estimated") + F.col("stale")).alias("pending"), "stale", "confidence")


_AUD = f"{POSTS}, {_INFO}, a AS (SELECT p.post_id, CASE WHEN l.post_id IS NULL THEN NULL WHEN coalesce(lang, 'und') = 'und' THEN 'unstated' ELSE lang END AS segment, coalesce(sure, 0) AS confidence, l.post_id IS NOT NULL AS known, l.sure IS NULL AS stale, nullif(nullif(lang, 'und'), '') AS region, CASE WHEN sentiment_label IN ('positive', 'negative') THEN sentiment_label END AS gender, schema_version AS age FROM p LEFT JOIN l USING (post_id))"


def _audience(spark: SparkSession, d: str) -> DataFrame:
    info = table(spark, d, "language_info").select("post_id", F.col("primary_lang").alias("lang"), F.col("lang_confidence").alias("sure"), F.lit(True).alias("is"))
    j = posts(spark, d).select("post_id", "sentiment_label", "schema_version").join(info, "post_id", "left")
    lang = F.coalesce("lang", F.lit("und"))
    return j.select(
        F.when(F.col("is").isNull(), None).when(lang == "und", "unstated").otherwise(F.col("lang")).alias("segment"), F.coalesce("sure", F.lit(0.0)).alias("confidence"), F.coalesce("is", F.lit(False)).alias("known"), F.col("sure").isNull().alias("stale"),
        F.nullif(F.nullif("lang", F.lit("und")), F.lit("")).alias("region"), F.when(F.col("sentiment_label").isin("positive", "negative"), F.col("sentiment_label")).alias("gender"), F.col("schema_version").alias("age"),
    )


@query(f"""WITH {_AUD}, g AS (SELECT segment, count(*) AS n, sum(confidence) AS t FROM a WHERE segment <> 'unstated' GROUP BY 1), x AS (SELECT *, sum(n) OVER () AS c FROM g) SELECT segment, n, floor(n / c::DOUBLE * 100 * 10 + 0.5) / 10 AS percent, floor(t / n * 100 + 0.5) / 100 AS confidence, CAST(row_number() OVER (ORDER BY n DESC, segment) AS INTEGER) AS place FROM x WHERE n >= 3""")
def segment_rollup_k3(spark: SparkSession, d: str) -> DataFrame:
    """Groups with three members or more."""
    return segment_groups(_audience(spark, d), "segment", "confidence")


@query(f"""WITH {_AUD}, g AS (SELECT segment, count(*) AS n FROM a GROUP BY 1) SELECT CAST(coalesce(sum(n) FILTER (segment IS NOT NULL), 0) AS BIGINT) AS estimated, CAST(coalesce(sum(n) FILTER (segment IS NULL), 0) AS BIGINT) AS pending, CAST(coalesce(sum(n) FILTER (segment <> 'unstated'), 0) AS BIGINT) AS classified, CAST(coalesce(sum(n) FILTER (segment = 'unstated'), 0) AS BIGINT) AS unstated, count(*) FILTER (segment <> 'unstated' AND n < 3) AS hidden_groups FROM g""")
def segment_coverage(spark: SparkSession, d: str) -> DataFrame:
    """What is estimated, pending, classified, unstated and hidden."""
    return segment_totals(_audience(spark, d), "segment")


_DIMS = "SELECT 'age' AS dimension, age AS value FROM a WHERE known UNION ALL SELECT 'gender', gender FROM a WHERE known UNION ALL SELECT 'region', region FROM a WHERE known"


@query(f"""WITH {_AUD}, l2 AS ({_DIMS}), g AS (SELECT dimension, value, count(*) AS n FROM l2 WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY dimension) AS total FROM g)
SELECT dimension, value, n, floor(n / total::DOUBLE * 100 * 10 + 0.5) / 10 AS percent, CAST(row_number() OVER (PARTITION BY dimension ORDER BY CASE WHEN dimension = 'age' THEN CASE value WHEN '0.9.2' THEN 1 WHEN '1.0.0' THEN 2 ELSE 0 END ELSE 0 END, n DESC, value) AS INTEGER) AS place FROM t WHERE n >= 2""")
def estimate_rollup_k2(spark: SparkSession, d: str) -> DataFrame:
    """Values of each dimension with two members or more; one dimension in its own order."""
    return estimate_groups(_audience(spark, d), ["age", "gender", "region"], "known", order={"age": ["0.9.2", "1.0.0"]})


@query(f"""WITH {_AUD}, l2 AS ({_DIMS}), g AS (SELECT dimension, value, count(*) AS n FROM l2 GROUP BY 1, 2), s AS (SELECT count(*) AS rows, count(*) FILTER (known) AS estimated, count(*) FILTER (known AND stale) AS stale, floor(avg(confidence) FILTER (known) * 100 + 0.5) / 100 AS confidence FROM a)
SELECT dimension, CAST(coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS BIGINT) AS total, any_value(estimated) - CAST(coalesce(sum(n) FILTER (value IS NOT NULL), 0) AS BIGINT) AS unclear, count(*) FILTER (value IS NOT NULL AND n < 2) AS hidden, any_value(estimated) AS estimated, any_value(rows - estimated + stale) AS pending, any_value(stale) AS stale, any_value(confidence) AS confidence FROM g, s GROUP BY dimension""")
def estimate_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Totals of each dimension: with a value, unclear, hidden, pending, stale."""
    return estimate_totals(_audience(spark, d), ["age", "gender", "region"], "known", "stale", "confidence")


@query(f"""WITH {POSTS}, x AS (SELECT sentiment_label AS said, CASE WHEN event_polarity = 'negative' THEN 'negative' WHEN event_polarity = 'positive' THEN 'positive' ELSE 'neutral' END AS truth, sentiment_source AS tier FROM p WHERE sentiment_label IN ('positive', 'neutral', 'negative')),
m AS (SELECT avg(CASE WHEN said = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM x), k AS (SELECT unnest(['positive', 'neutral', 'negative']) AS class), f AS (SELECT class, coalesce(2.0::DOUBLE * count(*) FILTER (said = class AND truth = class) / nullif(count(*) FILTER (said = class) + count(*) FILTER (truth = class), 0), 0) AS f1 FROM k, x GROUP BY class)
SELECT 'accuracy' AS measure, round((SELECT accuracy FROM m), 6) AS value UNION ALL SELECT 'macro_f1', round(avg(f1), 6) FROM f UNION ALL SELECT 'accuracy ' || coalesce(tier, 'pending'), round(avg(CASE WHEN said = truth THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) FROM x GROUP BY tier""")
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy overall and by tier, and macro F1, from one confusion table."""
    truth = F.when(F.col("event_polarity") == "negative", "negative").when(F.col("event_polarity") == "positive", "positive").otherwise("neutral")
    x = posts(spark, d).filter(F.col("sentiment_label").isin(*D.LABELS)).select(F.col("sentiment_label").alias("said"), truth.alias("truth"), F.coalesce("sentiment_source", F.lit("pending")).alias("tier"))
    m = x.groupBy("said", "truth", "tier").agg(F.count("*").alias("n"))  # at most 9 rows for each tier
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("double")
    right = F.col("said") == F.col("truth")
    f1 = [F.coalesce(F.try_divide(2 * part(right & (F.col("said") == k)), part(F.col("said") == k) + part(F.col("truth") == k)), F.lit(0.0)) for k in D.LABELS]
    whole = m.agg(F.try_divide(part(right), F.sum("n").cast("double")).alias("accuracy"), (sum(f1, F.lit(0.0)) / len(f1)).alias("macro_f1")).unpivot([], ["accuracy", "macro_f1"], "measure", "value")
    tiers = m.groupBy("tier").agg(F.try_divide(part(right), F.sum("n").cast("double")).alias("value")).select(F.concat(F.lit("accuracy "), "tier").alias("measure"), "value")
    return whole.unionByName(tiers).select("measure", F.round("value", 6).alias("value"))
