"""Spans, text variants, the chain of stages, and topics fitted without a model service."""

from __future__ import annotations

from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import decisions as D
from quillmark.functions import spans
from quillmark.functions import text as T
from quillmark.operators.gazetteer import civic, entities
from quillmark.plans.base import POSTS, posts, query
from quillmark.plans.collect_views import _inputs
from quillmark.plans.entity_views import TERMS
from quillmark.sources.tables import table

_RE = {"url": r"(?i)https?://\S+|www\.\S+", "hashtag": "#[A-Za-z0-9_]+"}
_NO_URL = "regexp_replace(original_text, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g')"
_NO_TAG = f"regexp_replace(regexp_replace({_NO_URL}, '@[A-Za-z0-9_]{{2,30}}\\b', ' ', 'g'), '#[A-Za-z0-9_]+', ' ', 'g')"


@query(f"""WITH {POSTS}, n AS (SELECT post_id, len(regexp_extract_all(original_text, '(?i)https?://\\S+|www\\.\\S+')) AS url, len(regexp_extract_all({_NO_URL}, '@[A-Za-z0-9_]{{2,30}}\\b')) AS mention, len(regexp_extract_all(regexp_replace({_NO_URL}, '@[A-Za-z0-9_]{{2,30}}\\b', ' ', 'g'), '#[A-Za-z0-9_]+')) AS hashtag,
len(regexp_extract_all(original_text, '!{{2,}}|\\?{{2,}}|\\.{{2,}}')) AS repeated, len(regexp_extract_all(original_text, '{T.EMOJI}')) AS emoji FROM p WHERE original_text IS NOT NULL) SELECT post_id, CAST(url AS INTEGER) AS url, CAST(mention AS INTEGER) AS mention, CAST(hashtag AS INTEGER) AS hashtag, CAST(repeated AS INTEGER) AS repeated, CAST(emoji AS INTEGER) AS emoji FROM n""")
def span_counts(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each kind; what a link claims is no mention or tag."""
    s = spans.with_spans(posts(spark, d).filter("original_text is not null"), "post_id", "original_text")
    n = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).alias(k)
    return s.select("post_id", *[n(k) for k in ("url", "mention", "hashtag", "repeated", "emoji")])


def frequent_words(df: DataFrame, text: str, most: int = 50_000) -> dict[str, int]:
    """Counts of the corpus's ``most`` frequent words of two letters or more, by which tags are cut; a bounded, documented sample of its words."""
    w = df.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    return {r.w: r.n for r in w.orderBy(F.desc("n"), "w").limit(most).collect()}


@query()
def text_variants(spark: SparkSession, d: str) -> DataFrame:
    """Words of tags and the texts for analysis and for parsing; tags without borders are cut by the corpus's own words."""
    counts = frequent_words(table(spark, d, "documents").filter("lang = 'en'"), "text")
    v = spans.with_spans(posts(spark, d).filter("original_text is not null"), "post_id", "original_text", set(counts), spans.word_costs(counts))
    return v.select("post_id", F.array_join("tag_words", " ").alias("tag_words"), "analysis_text", "nlp_text")


@query(f"WITH {POSTS} SELECT post_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(original_text, '(?i)https?://\\S+|www\\.\\S+', ' ', 'g'), '@[A-Za-z0-9_]{{2,30}}\\b', ' ', 'g'), '{T.EMOJI}', ' ', 'g'), '^[ \\t\\n#@:;,.!?_-]+', '')) = 0 AS empty FROM p WHERE original_text IS NOT NULL")
def empty_posts(spark: SparkSession, d: str) -> DataFrame:
    """Whether a post is nothing but links, mentions and emoji."""
    return posts(spark, d).filter("original_text is not null").select("post_id", T.empty_after_clean(F.col("original_text")).alias("empty"))


@query(f"WITH {POSTS} SELECT post_id, m AS marker FROM (SELECT post_id, unnest(list_filter([{', '.join(repr(m) for m in T.SARCASM)}], lambda x: contains(lower(original_text), x))) AS m FROM p) UNION ALL SELECT post_id, 'positive_words_with_negative_emoji' FROM p WHERE regexp_matches(original_text, '[{T.SOUR_FACES}]') AND regexp_matches(lower(original_text), '\\b({T.SWEET_WORDS})\\b')")
def sarcasm(spark: SparkSession, d: str) -> DataFrame:
    """Signs that the literal reading of a post is turned round."""
    return posts(spark, d).select("post_id", F.explode(T.sarcasm_markers(F.col("original_text"))).alias("marker"))


def enriched(df: DataFrame, key: str, text: str, author: str, guess: str, guess_sure: str, salt: bytes = b"salt") -> DataFrame:
    """The chain of stages over one table of texts, as one flat row for each.

    Guard (both redactions, pseudonym, hash of the redacted text, duplicates by
    first key), lexical counts, risk, event, variants' counts, language, dictionary
    entities, first pass and its reasons. All stages are column expressions over
    the redacted text, so the table is read once; the hash is the only shuffle.
    """
    clean, counts = T.redact_v2(T.redact_v1(F.col(text)))
    rest = [c for c in (guess, guess_sure) if c in df.columns]
    b = df.select(key, T.hmac_sha256(salt, F.col(author)).alias("author_ref_hash"), clean.alias("t"), *[c.alias(f"{k}_redacted") for k, c in counts.items()], *rest)
    t = F.col("t")
    hits = {k: T.term_hits(t, terms) for k, terms in T.HARM.items()}
    n = {k: F.size(h) for k, h in hits.items()}
    score = T.aggression(n["profanity"], n["threat"], n["identity_attack"], F.size(T.words(t)), T.caps_ratio(t), F.length(t), F.regexp_count(t, F.lit("!")))
    polarity, severity, categories = T.event_signal(t)
    lang = D.detected_language(t, F.col(guess), F.col(guess_sure))
    s = b.withColumns({
        "content_hash": F.sha2(T.hash_normal(t), 256), "char_count": F.length(t), "word_count": F.size(T.words(t)), "caps_ratio": T.caps_ratio(t), "exclamation_count": F.regexp_count(t, F.lit("!")), "question_count": F.regexp_count(t, F.lit(r"\?")),
        **hits, "aggression_score": score, "event_polarity": polarity, "event_severity": severity, "event_categories": categories, **lang, "entities": civic(entities(t, TERMS)),
    })
    s = s.withColumn("has_risk", (F.size("profanity") + F.size("threat") + F.size("identity_attack") > 0) | (F.col("aggression_score") >= 0.6))
    first = D.first_pass_lexicon(t, D.lexicon_scores(t), F.col("primary_lang"), F.col("lang_confidence"), F.col("is_code_mixed"), F.col("has_risk"))
    s = s.withColumns({"sentiment_label": first["label"], "sentiment_score": first["score"], "sentiment_confidence": first["confidence"], "sentiment_source": first["source"], "escalation_reasons": first["reasons"]})
    s = s.withColumn("escalated", F.size("escalation_reasons") > 0)
    heads = s.groupBy("content_hash").agg(F.min(key).alias("__first"))
    return s.join(heads, "content_hash").withColumn("is_duplicate", F.col(key) > F.col("__first")).drop("__first", *rest).withColumnRenamed("t", text)


@query()
def enriched_posts(spark: SparkSession, d: str) -> DataFrame:
    """Scraped posts through all stages, with the stored guesses as the detector."""
    info = table(spark, d, "language_info").select("post_id", F.get("candidates", F.lit(0))["lang"].alias("guess"), F.get("candidates", F.lit(0))["confidence"].alias("guess_sure"))
    i = _inputs(spark, d).filter("original_text is not null").join(info, "post_id", "left")
    e = enriched(i, "post_id", "original_text", "author_ref", "guess", "guess_sure")
    return e.select(*[F.array_join(c, "|").alias(c) if k == "array<string>" else F.size(c).alias("entity_count") if c == "entities" else F.col(c) for c, k in e.dtypes])


def fitted_topics(df: DataFrame, key: str, vector: str, text: str, topics: int, dims: int = 5, least: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Topics of vectors by principal components and bisecting k-means, with labels of their four weightiest words.

    ``(key, topic)`` and ``(topic, label)``; clusters below ``least`` rows are the
    outlier topic -1, which has a fixed label. An approximation of density
    clustering by built-in, distributed estimators.
    """
    v = df.select(key, text, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    reduced = PCA(k=dims, inputCol="v", outputCol="x").fit(v).transform(v)
    fit = BisectingKMeans(k=topics, minDivisibleClusterSize=float(least), seed=seed, featuresCol="x", predictionCol="topic").fit(reduced)
    t = fit.transform(reduced).select(key, text, "topic")
    big = t.groupBy("topic").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(F.col("topic").alias("big"))
    t = t.join(F.broadcast(big), F.col("topic") == F.col("big"), "left").withColumn("topic", F.coalesce("big", F.lit(-1))).drop("big")
    words = t.filter("topic >= 0").select("topic", F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]{3,}"), F.lit(0))).alias("w"))
    tf = words.filter(~F.col("w").rlike(r"^\p{N}+$")).groupBy("topic", "w").agg(F.count("*").alias("tf"))
    total = tf.groupBy("w").agg(F.sum("tf").alias("total"))
    average = tf.groupBy("topic").agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("average"))
    s = tf.join(total, "w").crossJoin(F.broadcast(average)).withColumn("s", F.round(F.col("tf") * F.log(1 + F.col("average") / F.col("total")), 9))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("s"), "w"))).filter("rn <= 4")
    labels = top.groupBy("topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "w"))), lambda x: x["w"]), " · ").alias("label"))
    return t.select(key, "topic"), labels.unionByName(df.sparkSession.createDataFrame([(-1, "Other comments")], labels.schema))


@query()
def topic_fit(spark: SparkSession, d: str) -> DataFrame:
    """Topics of the vectors table with labels of the documents of the same number."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id").filter("text is not null")
    own, labels = fitted_topics(e, "id", "embedding", "text", topics=8)
    return own.groupBy("topic").agg(F.count("*").alias("posts")).join(labels, "topic", "left")
