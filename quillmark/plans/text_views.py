"""Text operators over documents and posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.plans.base import POSTS, posts, query
from quillmark.sources.tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source").filter("text is not null")


# RE2 has no lookaround: signs other than word signs and dots are doubled, so that each number has its own borders.
_D2 = "regexp_replace(original_text, '([^\\p{L}\\p{N}_.])', '\\1\\1', 'g')"
_ID2 = "(?:^|[^\\p{L}\\p{N}_.])\\d{4}(?:\\s\\s|--)?\\d{4}(?:\\s\\s|--)?\\d{4}(?:$|[^\\p{L}\\p{N}_.])"


@query(f"WITH {POSTS} SELECT post_id, CAST(len(regexp_extract_all({_D2}, '{_ID2}')) AS INTEGER) AS id_numbers FROM p WHERE original_text IS NOT NULL")
def pii_id_counts(spark: SparkSession, d: str) -> DataFrame:
    """Twelve-digit numbers in a text by the second rule set, which redacts them first."""
    return posts(spark, d).filter("original_text is not null").select("post_id", T.redact_v2(F.col("original_text"))[1]["id_numbers"].alias("id_numbers"))


@query(f"WITH {POSTS} SELECT post_id, regexp_replace(original_text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{{2,}}', '[EMAIL]', 'g') AS redacted FROM p WHERE contains(original_text, '@')")
def pii_email_redact(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses as placeholders by the first rule set."""
    return posts(spark, d).filter(F.contains("original_text", F.lit("@"))).select("post_id", F.regexp_replace("original_text", T.EMAIL_V1, "[EMAIL]").alias("redacted"))


@query(f"WITH {POSTS} SELECT post_id, regexp_replace(original_text, '@[A-Za-z0-9_.]+', '@user', 'g') AS anonymised FROM p WHERE contains(original_text, '@')")
def mention_anonymise(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of accounts as one placeholder."""
    return posts(spark, d).filter(F.contains("original_text", F.lit("@"))).select("post_id", T.anonymised(F.col("original_text")).alias("anonymised"))


_V1_ID = "regexp_replace(regexp_replace(original_text, '[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\\b\\d{4}[ -]?\\d{4}[ -]?\\d{4}\\b', '[ID]', 'g')"


@query(f"WITH {POSTS} SELECT post_id, regexp_replace({_V1_ID}, '(^|[^A-Za-z0-9_])\\+?\\d[\\d ()-]{{8,}}\\d($|[^A-Za-z0-9_])', '\\1[PHONE]\\2', 'g') AS redacted FROM p WHERE original_text IS NOT NULL")
def pii_redact_v1(spark: SparkSession, d: str) -> DataFrame:
    """All three placeholders of the first rule set, in its order."""
    return posts(spark, d).filter("original_text is not null").select("post_id", T.redact_v1(F.col("original_text")).alias("redacted"))


@query()
def pii_redact_counts(spark: SparkSession, d: str) -> DataFrame:
    """Redaction with counts by class; both rule sets."""
    clean, n = T.redact_v2(F.col("original_text"))
    return posts(spark, d).filter("original_text is not null").select("post_id", T.redact_v1(F.col("original_text")).alias("redacted_v1"), clean.alias("redacted_v2"), *[c.alias(k) for k, c in n.items()])


@query("""WITH n AS (SELECT doc_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^\\s*RT\\s+@\\w+:\\s*', ''), 'https?://\\S+|www\\.\\S+', '', 'g'), '\\s+', ' ', 'g'))) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(t) AS content_hash, row_number() OVER (PARTITION BY sha256(t) ORDER BY doc_id) > 1 AS is_duplicate FROM n""")
def content_hash_dups(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the normalised text; later occurrences are duplicates."""
    h = _texts(spark, d).select("doc_id", F.sha2(T.hash_normal(F.col("text")), 256).alias("content_hash"))
    first = h.groupBy("content_hash").agg(F.min("doc_id").alias("first"))
    return h.join(first, "content_hash").select("doc_id", "content_hash", (F.col("doc_id") > F.col("first")).alias("is_duplicate"))


@query("SELECT DISTINCT user_id, left(sha256('salt:' || CAST(user_id AS VARCHAR)), 32) AS pseudonym FROM events")
def author_pseudonym(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().select("user_id", T.pseudonym("salt", F.col("user_id").cast("string")).alias("pseudonym"))


_PADS = ["".join(f"\\x{b:02X}" for b in bytes(x ^ pad for x in b"salt".ljust(64, b"\0"))) for pad in (0x36, 0x5C)]


@query(f"SELECT DISTINCT user_id, sha256('{_PADS[1]}'::BLOB || unhex(sha256('{_PADS[0]}'::BLOB || encode(CAST(user_id AS VARCHAR))))) AS pseudonym FROM events")
def author_hmac(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("user_id").distinct().select("user_id", T.hmac_sha256(b"salt", F.col("user_id").cast("string")).alias("pseudonym"))


@query("""SELECT doc_id, CAST(length(text) AS INTEGER) AS chars, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS INTEGER) AS words, CAST(length(text) - length(replace(text, '!', '')) AS INTEGER) AS exclamations, CAST(length(text) - length(replace(text, '?', '')) AS INTEGER) AS questions,
round(coalesce(length(regexp_replace(text, '[^\\p{Lu}]', '', 'g')) / nullif(CAST(length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS DOUBLE), 0), 0), 6) AS caps_ratio FROM documents WHERE text IS NOT NULL""")
def lexical_stats(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _texts(spark, d).select("doc_id", F.length(t).alias("chars"), F.size(T.words(t)).alias("words"), F.regexp_count(t, F.lit("!")).alias("exclamations"), F.regexp_count(t, F.lit(r"\?")).alias("questions"), F.round(T.caps_ratio(t), 6).alias("caps_ratio"))


_LONG, _MARKS = "|".join(f"{c}{{3,}}" for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), "!{2,}|\\?{2,}|\\.{2,}"


@query(f"WITH {POSTS} SELECT post_id, CAST(len(regexp_extract_all(original_text, '{_LONG}')) AS INTEGER) AS elongations, CAST(len(regexp_extract_all(original_text, '{_MARKS}')) AS INTEGER) AS repeated_marks FROM p WHERE original_text IS NOT NULL")
def elongation_counts(spark: SparkSession, d: str) -> DataFrame:
    """Letters drawn out and marks repeated."""
    t = F.col("original_text")
    return posts(spark, d).filter("original_text is not null").select("post_id", F.regexp_count(t, F.lit(r"([A-Za-z])\1{2,}")).alias("elongations"), F.regexp_count(t, F.lit(r"([!?.])\1+")).alias("repeated_marks"))


@query(f"""WITH {POSTS} SELECT post_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(original_text), '[a-z]+'), lambda x: x IN ({", ".join(repr(s) for s in T.SLANG)})))), ' ') AS slang FROM p WHERE original_text IS NOT NULL AND regexp_matches(lower(original_text), '(^|[^a-z])({"|".join(T.SLANG)})([^a-z]|$)')""")
def slang_hits(spark: SparkSession, d: str) -> DataFrame:
    w = F.regexp_extract_all(F.lower("original_text"), F.lit("[a-z]+"), F.lit(0))
    hits = F.array_sort(F.array_intersect(w, F.array(*map(F.lit, T.SLANG))))
    return posts(spark, d).filter("original_text is not null").select("post_id", hits.alias("h")).filter(F.size("h") > 0).select("post_id", F.array_join("h", " ").alias("slang"))


def _weight(terms: str, weight: float) -> str:
    return f"CASE WHEN regexp_matches(t, '(^|[^a-z])({terms})([^a-z]|$)') THEN {weight}::DOUBLE ELSE 0 END"


def _event_sql() -> str:
    cats = [(pol, name, weight, terms) for pol, groups in T.EVENTS.items() for name, (weight, terms) in groups.items()]
    flags = ", ".join(f"{_weight(terms, weight)} AS {name}" for _, name, weight, terms in cats)
    of = {pol: [name for q, name, _, _ in cats if q == pol] for pol in T.EVENTS}
    seen = {"negative": of["negative"], "positive": of["negative"] + of["positive"]}
    n = {p: " + ".join(f"(w.{c} > 0)::INT" for c in names) for p, names in seen.items()}
    best = {p: f"greatest({', '.join('w.' + c for c in names)})" for p, names in of.items()}
    score = ", ".join(f"CASE WHEN {best[p]} > 0 THEN least(1.0::DOUBLE, {best[p]} + 0.05::DOUBLE * greatest({n[p]} - 1, 0)) ELSE 0 END AS {p[:3]}" for p in T.EVENTS)
    names = ", ".join(f"CASE WHEN w.{c} > 0 THEN '{c}' END" for _, c, _, _ in cats)
    return f"""WITH {POSTS}, t AS (SELECT post_id, lower(original_text) AS t FROM p WHERE original_text IS NOT NULL), w AS (SELECT post_id, {flags} FROM t), s AS (SELECT post_id, {score}, array_to_string(list_sort(list_filter([{names}], lambda x: x IS NOT NULL)), ' ') AS categories FROM w),
v AS (SELECT *, CASE WHEN greatest(neg, pos) < 0.25 THEN 'none' WHEN neg > 0 AND neg >= greatest(neg, pos) - 0.1::DOUBLE THEN 'negative' ELSE 'positive' END AS polarity FROM s)
SELECT post_id, polarity, round(CASE polarity WHEN 'none' THEN 0 WHEN 'negative' THEN neg ELSE pos END, 4) AS severity, categories FROM v"""


@query(_event_sql())
def event_signal(spark: SparkSession, d: str) -> DataFrame:
    pol, sev, cats = T.event_signal(F.col("original_text"))
    return posts(spark, d).filter("original_text is not null").select("post_id", pol.alias("polarity"), sev.alias("severity"), F.array_join(cats, " ").alias("categories"))


def _case(terms: str) -> str:
    return f"CASE WHEN regexp_matches(t, '(^|[^a-z])({terms})([^a-z]|$)') THEN 1 ELSE 0 END"


@query(f"""WITH {POSTS}, t AS (SELECT post_id, lower(original_text) AS t FROM p WHERE original_text IS NOT NULL) SELECT post_id, {_case(T.HARM['profanity'])} AS profanity, {_case(T.HARM['threat'])} AS threat, {_case(T.HARM['identity_attack'])} AS identity_attack FROM t""")
def risk_flags(spark: SparkSession, d: str) -> DataFrame:
    """Whether a post holds a risk term of each kind."""
    t = F.col("original_text")
    return posts(spark, d).filter("original_text is not null").select("post_id", *[F.when(T.has_term(t, terms), 1).otherwise(0).alias(k) for k, terms in T.HARM.items()])


def _hits(terms: str) -> str:
    """Distinct sorted terms; signs that are no Latin letters are doubled, also inside terms, so that each term has its own borders."""
    alts = "|".join(t.replace(" ", "  ") for t in sorted(terms.split("|"), key=len, reverse=True))
    return f"list_sort(list_distinct(list_transform(regexp_extract_all(d, '(?:^|[^a-z])({alts})(?:[^a-z]|$)', 1), lambda x: replace(x, '  ', ' '))))"


@query(f"""WITH {POSTS}, t AS (SELECT post_id, original_text AS t, regexp_replace(lower(original_text), '([^a-z])', '\\1\\1', 'g') AS d FROM p WHERE original_text IS NOT NULL),
h AS (SELECT post_id, {_hits(T.HARM['profanity'])} AS profanity, {_hits(T.HARM['threat'])} AS threat, {_hits(T.HARM['identity_attack'])} AS identity_attack, len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) AS n, length(t) AS chars, length(t) - length(replace(t, '!', '')) AS marks,
coalesce(length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace(t, '[^\\p{{L}}]', '', 'g'))::DOUBLE, 0), 0) AS caps FROM t),
s AS (SELECT *, round(least(1.0::DOUBLE, 0.5::DOUBLE * least((len(profanity) + 2 * len(threat) + 2 * len(identity_attack)) / greatest(n, 1)::DOUBLE * 4, 1.0::DOUBLE) + 0.3::DOUBLE * CASE WHEN chars > 8 THEN caps ELSE 0 END + 0.2::DOUBLE * least(marks / 5.0::DOUBLE, 1.0::DOUBLE)), 4) AS score FROM h)
SELECT post_id, array_to_string(profanity, ' ') AS profanity, array_to_string(threat, ' ') AS threat, array_to_string(identity_attack, ' ') AS identity_attack, score AS aggression_score, len(profanity) + len(threat) + len(identity_attack) > 0 OR score >= 0.6 AS has_risk FROM s""")
def risk_signals(spark: SparkSession, d: str) -> DataFrame:
    """Risk terms found and the aggression score."""
    t = F.col("original_text")
    hits = {k: T.term_hits(t, terms) for k, terms in T.HARM.items()}
    n = {k: F.size(h) for k, h in hits.items()}
    score = T.aggression(n["profanity"], n["threat"], n["identity_attack"], F.size(T.words(t)), T.caps_ratio(t), F.length(t), F.regexp_count(t, F.lit("!")))
    return posts(spark, d).filter("original_text is not null").select("post_id", *[F.array_join(h, " ").alias(k) for k, h in hits.items()], score.alias("aggression_score"), ((sum(n.values(), F.lit(0)) > 0) | (score >= 0.6)).alias("has_risk"))


@query("""SELECT doc_id, CAST(length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) AS INTEGER) AS ascii_letters, CAST(length(regexp_replace(text, '[^\\x{0B85}-\\x{0BB9}]', '', 'g')) AS INTEGER) AS tamil, CAST(length(regexp_replace(text, '[^\\x{0905}-\\x{0939}]', '', 'g')) AS INTEGER) AS devanagari FROM documents WHERE text IS NOT NULL""")
def script_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Letters by script; vowel signs are not counted."""
    t = F.col("text")
    only = lambda keep: F.length(F.regexp_replace(t, keep, ""))
    return _texts(spark, d).select("doc_id", only("[^a-zA-Z]").alias("ascii_letters"), only(r"[^\x{0B85}-\x{0BB9}]").alias("tamil"), only(r"[^\x{0905}-\x{0939}]").alias("devanagari"))


_FUNC, _DIST = (", ".join(f"'{w}'" for w in ws) for ws in (T.FUNCTION_WORDS, T.DISTINCTIVE))


@query(f"""WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: trim(x, chr(39))) AS r FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, r, list_filter(r, lambda x: x <> '') AS ws FROM r),
h AS (SELECT *, list_filter(list_transform(ws, lambda x: CASE WHEN x IN ({_FUNC}) THEN x WHEN contains(x, chr(39)) AND split_part(x, chr(39), 1) IN ({_FUNC}) THEN split_part(x, chr(39), 1) END), lambda x: x IS NOT NULL) AS hit, list_concat(r, list_transform(list_filter(r, lambda x: contains(x, chr(39))), lambda x: split_part(x, chr(39), 1))) AS every FROM w)
SELECT doc_id, CAST(len(ws) AS INTEGER) AS tokens, CAST(len(list_distinct(hit)) AS INTEGER) AS hits, round(coalesce(len(hit) / nullif(len(ws)::DOUBLE, 0), 0), 6) AS ratio, CAST(len(list_distinct(list_filter(every, lambda x: x IN ({_DIST})))) AS INTEGER) AS distinctive FROM h""")
def english_evidence(spark: SparkSession, d: str) -> DataFrame:
    """English function words of a text, their share, and distinct words that are English only."""
    hits, ratio, tokens = T.english_evidence(F.col("text"))
    return _texts(spark, d).select("doc_id", tokens.alias("tokens"), hits.alias("hits"), F.round(ratio, 6).alias("ratio"), T.distinctive_hits(F.col("text")).alias("distinctive"))


def _alts(words: list[str]) -> str:
    return "|".join(words)


_TOKENS = "regexp_extract_all(original_text, '[\\p{L}\\p{M}\\p{N}]+')"
_STEM, _WHOLE = f"(?i)^(?:{_alts(T.MASK_STEMS)})", f"(?i)^(?:{_alts(T.MASK_WORDS)})$"


@query(f"""WITH {POSTS}, w AS (SELECT post_id, list_filter({_TOKENS}, lambda x: regexp_matches(x, '{_STEM}') OR regexp_matches(x, '{_WHOLE}')) AS ws FROM p WHERE original_text IS NOT NULL),
m AS (SELECT post_id, list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '{_STEM}') THEN regexp_extract(x, '{_STEM}[\\p{{L}}\\p{{M}}]*') ELSE x END) AS ws FROM w WHERE len(ws) > 0)
SELECT post_id, CAST(len(ws) AS INTEGER) AS masked, array_to_string(list_transform(ws, lambda x: regexp_extract(x, '^.\\p{{M}}*') || repeat('*', greatest(length(regexp_replace(x, '\\p{{M}}', '', 'g')) - 1, 1))), ' ') AS masked_words FROM m""")
def profanity_mask_count(spark: SparkSession, d: str) -> DataFrame:
    """Words masked for display, and how they are shown."""
    t = F.col("original_text")
    return posts(spark, d).filter("original_text is not null").select("post_id", T.masked_count(t).alias("masked"), F.array_join(T.masked_words(t), " ").alias("masked_words")).filter("masked > 0")


@query()
def content_hash_nfkc(spark: SparkSession, d: str) -> DataFrame:
    """Hash of the normalised text of posts, compatibility forms folded first; later occurrences are duplicates."""
    h = posts(spark, d).filter("original_text is not null").select("post_id", "processed_at", F.sha2(T.hash_normal(T.nfkc(F.col("original_text"))), 256).alias("content_hash"))
    first = h.groupBy("content_hash").agg(F.min(F.struct("processed_at", "post_id")).alias("first"))
    return h.join(first, "content_hash").select("post_id", "content_hash", (F.struct("processed_at", "post_id") > F.col("first")).alias("is_duplicate"))


_YT = "^(?i:https?://(?:www\\.|m\\.)?youtube\\.com/"


@query(f"""WITH {POSTS}, u AS (SELECT post_id, unnest(regexp_extract_all(original_text, 'https?://\\S+')) AS url FROM p WHERE original_text IS NOT NULL)
SELECT post_id, url, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '{_YT}watch)\\?(?:[^#]*&)?v=([A-Za-z0-9_-]{{11}})(?:[&#]|$)', 1) || regexp_extract(url, '{_YT}(?:shorts|live|embed)/)([A-Za-z0-9_-]{{11}})(?:[/?#]|$)', 1) || regexp_extract(url, '^(?i:https?://youtu\\.be/)([A-Za-z0-9_-]{{11}})(?:[/?#]|$)', 1), '') AS video_id FROM u""")
def url_classify(spark: SparkSession, d: str) -> DataFrame:
    """Links in posts by host, with the video id where there is one."""
    urls = F.explode(F.regexp_extract_all("original_text", F.lit(r"https?://\S+"), F.lit(0)))
    u = posts(spark, d).filter("original_text is not null").select("post_id", urls.alias("url"))
    return u.select("post_id", "url", F.regexp_extract("url", r"^https?://([^/?#]+)", 1).alias("host"), T.video_id(F.col("url")).alias("video_id"))


@query("""WITH t AS (SELECT source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{N}_]+')) AS w FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), tf AS (SELECT source, w, count(*) AS tf FROM t WHERE length(w) > 2 AND NOT regexp_full_match(w, '\\p{N}+') GROUP BY 1, 2), tot AS (SELECT w, sum(tf) AS total FROM tf GROUP BY w), av AS (SELECT avg(n) AS average FROM (SELECT source, sum(tf) AS n FROM tf GROUP BY source)),
s AS (SELECT source, w, tf * ln(1 + average / total) AS weight FROM tf JOIN tot USING (w), av), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(weight, 6) DESC, w) AS rn FROM s) SELECT source, w AS word, round(weight, 6) AS weight FROM r WHERE rn <= 4""")
def ctfidf_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Four words of each source by class-based TF-IDF.

    Words are counted for each source before anything is shuffled whole; totals
    are joined by word, and the average is one row.
    """
    w = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0)))
    tf = _texts(spark, d).filter("source is not null").select("source", w.alias("word")).filter((F.length("word") > 2) & ~F.col("word").rlike(r"^\p{N}+$")).groupBy("source", "word").agg(F.count("*").alias("tf"))
    total = tf.groupBy("word").agg(F.sum("tf").alias("total"))
    average = tf.groupBy("source").agg(F.sum("tf").alias("n")).agg(F.avg("n").alias("average"))
    s = tf.join(total, "word").crossJoin(F.broadcast(average)).withColumn("weight", F.round(F.col("tf") * F.log(1 + F.col("average") / F.col("total")), 6))
    r = s.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "word")))
    return r.filter("rn <= 4").select("source", "word", "weight")
