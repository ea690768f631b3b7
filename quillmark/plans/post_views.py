"""Rollups, projections and predicates of post views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions import text as T
from quillmark.functions import urls
from quillmark.functions.math import exact_mean, ist
from quillmark.operators.latest import latest_by
from quillmark.plans.base import DETAILS, POSTS, details, posts, query
from quillmark.plans.growth_views import CLUSTERED
from quillmark.sources.tables import table

_SEQ = "created_at NULLS LAST, post_id"
_DISPLAY = "CASE WHEN regexp_replace(topic, '[·\\s]', '', 'g') <> '' THEN topic WHEN topic_source IN ('BERTopic', 'Embedding clusters') THEN 'Topic (keywords unavailable)' ELSE 'Topic analysis pending' END"
_KEYED = f"{DETAILS}, t AS (SELECT post_id, source, source_url, created_at, topic_source, {_DISPLAY} AS shown, CASE WHEN topic_source IN ('BERTopic', 'Embedding clusters') THEN coalesce(source, 'manual') || ':' || coalesce(topic, '') ELSE {_DISPLAY} END AS key FROM a WHERE topic IS DISTINCT FROM 'Other comments')"


def topic_display(topic: Column, source: Column) -> Column:
    """The topic as shown: its words, or that these are missing or still to come."""
    return F.when(F.regexp_replace(topic, r"[·\s]", "") != "", topic).when(source.isin(*CLUSTERED), "Topic (keywords unavailable)").otherwise("Topic analysis pending")


def topic_key(topic: Column, source: Column, group: Column) -> Column:
    """Key of a topic: topics of a clustering belong to one source group, others to their display name."""
    return F.when(source.isin(*CLUSTERED), F.concat_ws(":", F.coalesce(group, F.lit("manual")), F.coalesce(topic, F.lit("")))).otherwise(topic_display(topic, source))


def _topics(spark: SparkSession, d: str) -> DataFrame:
    a = details(spark, d).filter(~F.col("topic").eqNullSafe("Other comments"))
    topic, source = F.col("topic"), F.col("topic_source")
    return a.select("post_id", "source", "source_url", "created_at", "topic_source", topic_display(topic, source).alias("shown"), topic_key(topic, source, F.col("source")).alias("key"))


@query(f"""WITH {POSTS}, {_KEYED}, e AS (SELECT key, string_agg(source_url, ' ' ORDER BY rn) AS evidence FROM (SELECT key, source_url, row_number() OVER (PARTITION BY key ORDER BY {_SEQ}) AS rn FROM t WHERE source_url IS NOT NULL) WHERE rn <= 3 GROUP BY key),
g AS (SELECT key, count(*) AS posts, count(*) FILTER (p.has_risk) AS abusive, round(sum(coalesce(p.sentiment_score, 0)) / count(*), 6) AS mean_score, round(avg(p.sentiment_score), 6) AS mean_scored, first(shown ORDER BY t.created_at NULLS LAST, t.post_id) AS topic, last(topic_source ORDER BY t.created_at NULLS LAST, t.post_id) AS last_source FROM t LEFT JOIN p USING (post_id) GROUP BY key)
SELECT g.*, e.evidence, CAST(row_number() OVER (ORDER BY posts DESC, key) AS INTEGER) AS place FROM g LEFT JOIN e USING (key)""")
def topic_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Each topic with its posts, abusive ones, mean scores (unknown as 0, and known only), first label, last method and first three links.

    The catch-all topic is left out. Links are cut to three for each topic before
    they are listed, so a topic of any size is counted by partial sums alone.
    """
    t = _topics(spark, d)
    seq = F.struct(F.col("created_at").isNull(), "created_at", "post_id")
    w = Window.partitionBy("key").orderBy(F.col("created_at").asc_nulls_last(), "post_id")
    e = t.filter("source_url is not null").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "source_url"))), lambda x: x["source_url"]), " ").alias("evidence"))
    j = t.join(posts(spark, d).select("post_id", "has_risk", "sentiment_score"), "post_id", "left")
    g = j.groupBy("key").agg(
        F.count("*").alias("posts"), F.count_if("has_risk").alias("abusive"), exact_mean(F.coalesce("sentiment_score", F.lit(0.0)), F.count("*"), 6).alias("mean_score"), exact_mean(F.col("sentiment_score"), F.count("sentiment_score"), 6).alias("mean_scored"),
        F.min_by("shown", seq).alias("topic"), F.max_by("topic_source", seq).alias("last_source"),
    )
    return g.join(e, "key", "left").withColumn("place", F.row_number().over(Window.orderBy(F.desc("posts"), "key")))


@query(f"WITH {POSTS} SELECT post_id FROM p WHERE NOT (source = 'telegram' OR starts_with(post_id, 'x:'))")
def seed_exclusion(spark: SparkSession, d: str) -> DataFrame:
    """Posts that are no seeds, by source or by the head of their id."""
    return without_seeds(posts(spark, d), "telegram", "x:").select("post_id")


def without_seeds(df: DataFrame, source: str = "seed", head: str = "seed", flag: str | None = None) -> DataFrame:
    """Rows that are not marked as seeds by a flag, their source or the head of their id; nulls mark nothing."""
    seed = (F.col("source") == source) | F.col("post_id").startswith(head)
    if flag:
        seed = seed | F.col(flag)
    return df.filter(~F.coalesce(seed, F.lit(False)))


@query(f"WITH {POSTS} SELECT source, count(*) AS scored, round(avg(sentiment_score), 6) AS mean FROM p WHERE isfinite(sentiment_score) AND coalesce(sentiment_source, '') NOT IN ('unavailable', 'skipped_empty') AND coalesce(sentiment_label, '') <> 'unavailable' GROUP BY source")
def scored_posts(spark: SparkSession, d: str) -> DataFrame:
    """Posts with a real score by source."""
    s = F.col("sentiment_score")
    real = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf")) & ~F.coalesce("sentiment_source", F.lit("")).isin("unavailable", "skipped_empty") & (F.coalesce("sentiment_label", F.lit("")) != "unavailable")
    return posts(spark, d).filter(real).groupBy("source").agg(F.count("*").alias("scored"), F.round(F.avg(s), 6).alias("mean"))


_FLAT = "post_id, schema_version, source, author_ref_hash, parent_id, content_hash, is_duplicate, original_text, sentiment_label, sentiment_score, sentiment_confidence, sentiment_source, p.has_risk, p.aggression_score, event_polarity, event_severity"


@query(f"""WITH {POSTS} SELECT {_FLAT.replace('post_id', 'p.post_id', 1)}, epoch_us(p.created_at) AS created_us, epoch_us(p.processed_at) AS processed_us, l.primary_lang, l.lang_confidence, l.is_code_mixed, candidates[1].lang AS first_candidate, CAST(coalesce(len(candidates), -1) AS INTEGER) AS candidates, array_to_string(profanity, '|') AS profanity, array_to_string(threat, '|') AS threat, array_to_string(identity_attack, '|') AS identity_attack
FROM p LEFT JOIN language_info l ON l.post_id = p.post_id LEFT JOIN risk_signals k ON k.post_id = p.post_id""")
def flat_posts(spark: SparkSession, d: str) -> DataFrame:
    """One flat row for each post, with what the language and risk stages found."""
    info = table(spark, d, "language_info").select("post_id", "primary_lang", "lang_confidence", "is_code_mixed", F.get("candidates", F.lit(0))["lang"].alias("first_candidate"), F.coalesce(F.size("candidates"), F.lit(-1)).alias("candidates"))
    risk = table(spark, d, "risk_signals").select("post_id", *[F.array_join(c, "|").alias(c) for c in ("profanity", "threat", "identity_attack")])
    keep = [c.removeprefix("p.") for c in _FLAT.split(", ")]
    j = posts(spark, d).select(*keep, F.unix_micros("created_at").alias("created_us"), F.unix_micros("processed_at").alias("processed_us")).join(info, "post_id", "left").join(risk, "post_id", "left")
    return j.withColumn("candidates", F.coalesce("candidates", F.lit(-1)))


@query(f"""WITH {DETAILS}, r AS (SELECT post_id, source, topic, metadata.metrics.like_count AS likes, epoch_us(created_at) AS created_us, source_url FROM a) SELECT * FROM r WHERE source = 'youtube' ORDER BY post_id LIMIT 20 OFFSET 20""")
def rows_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of twenty rows of a route: chosen columns, a filter and an order; vectors and pseudonyms never leave."""
    r = details(spark, d).filter("source = 'youtube'").select("post_id", "source", "topic", F.col("metadata.metrics.like_count").alias("likes"), F.unix_micros("created_at").alias("created_us"), "source_url")
    return r.orderBy("post_id").offset(20).limit(20)


@query(f"""WITH {POSTS}, {DETAILS}, j AS (SELECT strftime(a.created_at, '%Y-%m-%d') AS date, p.sentiment_score AS s, a.topic FROM a LEFT JOIN p USING (post_id) WHERE a.metadata.content_kind IS DISTINCT FROM 'video' AND a.created_at IS NOT NULL),
t AS (SELECT date, topic, count(*) AS n, count(s) AS scored, sum(s) AS total FROM j GROUP BY 1, 2) SELECT date, CAST(sum(n) AS BIGINT) AS n, CAST(sum(scored) AS BIGINT) AS scored, round(sum(total) / nullif(sum(scored), 0), 6) AS score, coalesce(string_agg(topic || '=' || n, ' ' ORDER BY topic) FILTER (topic IS NOT NULL), '') AS topics FROM t GROUP BY date""")
def timeline_topics(spark: SparkSession, d: str) -> DataFrame:
    """Days with posts, scored posts, mean score and posts of each topic."""
    a = details(spark, d).filter(~F.col("metadata.content_kind").eqNullSafe("video") & F.col("created_at").isNotNull()).select("post_id", F.date_format("created_at", "yyyy-MM-dd").alias("date"), "topic")
    t = a.join(posts(spark, d).select("post_id", F.col("sentiment_score").alias("s")), "post_id", "left").groupBy("date", "topic").agg(F.count("*").alias("n"), F.count("s").alias("scored"), F.sum("s").alias("total"))
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("topic", "n")))), lambda x: F.concat(x["topic"], F.lit("="), x["n"].cast("string")))
    return t.groupBy("date").agg(F.sum("n").alias("n"), F.sum("scored").alias("scored"), F.round(F.try_divide(F.sum("total"), F.sum("scored").cast("double")), 6).alias("score"), F.array_join(listed, " ").alias("topics"))


@query(f"""WITH {POSTS}, u AS (SELECT author_ref_hash, count(*) AS n FROM p WHERE author_ref_hash IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM u) AS commenters, (SELECT count(*) FROM u WHERE n = 1) AS one_time, (SELECT count(*) FROM u WHERE n > 1) AS repeat, count(*) FILTER (parent_id IS NULL) AS top_level, count(*) FILTER (parent_id IS NOT NULL) AS replies, count(*) FILTER (has_risk) AS abusive FROM p""")
def participation_full(spark: SparkSession, d: str) -> DataFrame:
    """Distinct, one-time and repeating authors; top-level posts, replies, abusive posts.

    Authors are counted with their posts in one aggregation, whose few hundred
    partial rows carry all six figures.
    """
    per = posts(spark, d).groupBy("author_ref_hash").agg(F.count("*").alias("n"), F.count_if(F.col("parent_id").isNull()).alias("top"), F.count_if("has_risk").alias("bad"))
    known = F.col("author_ref_hash").isNotNull()
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(F.count_if(known).alias("commenters"), F.count_if(known & (F.col("n") == 1)).alias("one_time"), F.count_if(known & (F.col("n") > 1)).alias("repeat"), total("top").alias("top_level"), total(F.col("n") - F.col("top")).alias("replies"), total("bad").alias("abusive"))


@query(f"""WITH {POSTS}, a AS (SELECT * FROM (SELECT post_id, topic, metadata, len(embedding) AS size, row_number() OVER (PARTITION BY post_id ORDER BY updated_at DESC NULLS LAST, topic DESC NULLS LAST, topic_source DESC NULLS LAST) AS rn FROM argus_post_details WHERE post_id IS NOT NULL) WHERE rn = 1)
SELECT count(*) AS records, count(*) FILTER (metadata.content_kind IS DISTINCT FROM 'video') AS comments, count(*) FILTER (metadata.content_kind = 'video') AS videos, count(*) FILTER (size = 384) AS embeddings, count(p.post_id) AS nlp, count(*) FILTER (topic = 'Other comments') AS outliers, count(*) FILTER (topic IS NULL) AS without_topic, count(*) FILTER (p.has_risk) AS risky FROM a LEFT JOIN p USING (post_id)""")
def coverage_counts(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of the stages; a null kind counts as a comment. Of the vectors only their length is read on."""
    df = table(spark, d, "argus_post_details").select("post_id", "topic", "topic_source", F.col("metadata.content_kind").alias("kind"), F.size("embedding").alias("size"), "updated_at")
    a = latest_by(df, ["post_id"], "updated_at", [F.col("topic"), F.col("topic_source")])
    j = a.join(posts(spark, d).select("post_id", F.lit(True).alias("found"), "has_risk"), "post_id", "left")
    video = F.col("kind").eqNullSafe("video")
    return j.agg(F.count("*").alias("records"), F.count_if(~video).alias("comments"), F.count_if(video).alias("videos"), F.count_if(F.col("size") == 384).alias("embeddings"), F.count_if("found").alias("nlp"), F.count_if(F.col("topic") == "Other comments").alias("outliers"), F.count_if(F.col("topic").isNull()).alias("without_topic"), F.count_if("has_risk").alias("risky"))


@query(f"""WITH {POSTS}, {DETAILS}, e AS (SELECT p.author_ref_hash AS author, coalesce(a.metadata.metrics.like_count, 0) + coalesce(a.metadata.metrics.reply_count, 0) AS e FROM p LEFT JOIN a USING (post_id) WHERE p.author_ref_hash IS NOT NULL) SELECT 'Author ' || left(author, 8) AS label, count(*) AS posts, CAST(sum(e) AS BIGINT) AS engagement FROM e GROUP BY author ORDER BY engagement DESC, author LIMIT 5""")
def author_engagement_top5(spark: SparkSession, d: str) -> DataFrame:
    """The five authors with the most engagement: the sum of the known counters of their posts."""
    a = details(spark, d).select("post_id", engagement("metadata.metrics", ["like_count", "reply_count"]).alias("e"))
    j = posts(spark, d).filter("author_ref_hash is not null").select("post_id", F.col("author_ref_hash").alias("author")).join(a, "post_id", "left")
    g = j.groupBy("author").agg(F.count("*").alias("posts"), F.sum(F.coalesce("e", F.lit(0))).alias("engagement")).orderBy(F.desc("engagement"), "author").limit(5)
    return g.select(F.concat(F.lit("Author "), F.left("author", F.lit(8))).alias("label"), "posts", "engagement")


def engagement(metrics: str, counters: list[str]) -> Column:
    """Sum of the known counters of a row; other metrics are ignored."""
    return sum((F.coalesce(F.col(f"{metrics}.{c}"), F.lit(0)) for c in counters), F.lit(0))


@query("SELECT e, count(*) AS n FROM (SELECT unnest(list_distinct(coalesce(profanity, identity_attack))) AS e FROM risk_signals) GROUP BY e")
def emotion_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of a list in each row; the first list counts even when it is empty, the second only where the first is null."""
    return table(spark, d, "risk_signals").select(F.explode(F.array_distinct(F.coalesce("profanity", "identity_attack"))).alias("e")).groupBy("e").agg(F.count("*").alias("n"))


@query(f"WITH {POSTS}, c AS (SELECT source, count(*) FILTER (sentiment_label = 'negative') AS neg, count(*) AS n FROM p GROUP BY source) SELECT source, round_even(neg * 100.0::DOUBLE / n, 0) AS negative_percent FROM c")
def negative_share(spark: SparkSession, d: str) -> DataFrame:
    """Negative posts as a whole percent of each source; halves go to the even number."""
    g = posts(spark, d).groupBy("source").agg(F.count_if(F.col("sentiment_label") == "negative").alias("neg"), F.count("*").alias("n"))
    return g.select("source", F.rint(F.col("neg") * 100.0 / F.col("n")).alias("negative_percent"))


@query("""WITH t AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT event_type FROM t GROUP BY 1 ORDER BY sum(n) DESC, event_type LIMIT 4), s AS (SELECT day, sum(n) AS stacked FROM t WHERE event_type IN (SELECT event_type FROM k) GROUP BY day) SELECT CAST(max(stacked) AS BIGINT) AS peak, min_by(day, struct_pack(a := -stacked, b := day)) AS day FROM s""")
def stacked_peak(spark: SparkSession, d: str) -> DataFrame:
    """The largest daily total over the four most frequent kinds and its first day."""
    t = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    k = t.groupBy("event_type").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "event_type").limit(4)
    s = t.join(k, "event_type", "left_semi").groupBy("day").agg(F.sum("n").alias("stacked"))
    return s.agg(F.max("stacked").alias("peak"), F.min_by("day", F.struct(-F.col("stacked"), "day")).alias("day"))


@query("SELECT CAST(ts AS DATE) AS day, event_type AS model, count(*) AS calls, count(DISTINCT user_id) AS keys FROM events GROUP BY 1, 2")
def calls_per_day(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each day and model."""
    return table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("keys"))


@query(f"""WITH {POSTS}, {DETAILS} SELECT a.post_id, a.source_url, left(p.original_text, 140) AS text, p.sentiment_label FROM a LEFT JOIN p USING (post_id) WHERE a.metadata.content_kind IS DISTINCT FROM 'video' AND a.source_url IS NOT NULL ORDER BY a.created_at NULLS LAST, a.post_id LIMIT 12""")
def evidence_first12(spark: SparkSession, d: str) -> DataFrame:
    """The first twelve comments with a link, their texts cut for display; twelve keys are chosen before any text is joined."""
    a = details(spark, d).filter(~F.col("metadata.content_kind").eqNullSafe("video") & F.col("source_url").isNotNull()).select("post_id", "source_url", "created_at").orderBy(F.col("created_at").asc_nulls_last(), "post_id").limit(12)
    own = table(spark, d, "posts_nlp").join(F.broadcast(a.select("post_id")), "post_id", "left_semi")
    p = latest_by(own, ["post_id"], "processed_at", [F.col("content_hash"), F.col("sentiment_score"), F.col("schema_version")])
    return a.join(p.select("post_id", T.cut_to(F.col("original_text"), 140).alias("text"), "sentiment_label"), "post_id", "left").select("post_id", "source_url", "text", "sentiment_label")


@query(f"WITH {POSTS} SELECT post_id, CAST(row_number() OVER (ORDER BY processed_at, post_id) AS INTEGER) AS place FROM p WHERE has_risk AND sentiment_label = 'unavailable' ORDER BY place LIMIT 30")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """The thirty posts that wait longest, oldest first."""
    q = posts(spark, d).filter("has_risk and sentiment_label = 'unavailable'").select("post_id", "processed_at").orderBy("processed_at", "post_id").limit(30)
    return q.select("post_id", F.row_number().over(Window.orderBy("processed_at", "post_id")).alias("place"))


#: Text fields of a record that are masked for display.
MASKED_FIELDS = ("original_text", "topic", "topic_summary", "topic_keywords", "context_title", "title", "nlp_text")


def masked_record(df: DataFrame, text: str = "original_text", fields: tuple[str, ...] = MASKED_FIELDS) -> DataFrame:
    """The rows with all text fields they have masked, and ``abusive`` where the text itself was."""
    have = [f for f in fields if f in df.columns]
    return df.withColumn("abusive", F.coalesce(T.masked_count(F.col(text)) > 0, F.lit(False))).withColumns({f: T.mask(F.col(f)) for f in have})


@query()
def masked_records(spark: SparkSession, d: str) -> DataFrame:
    """Posts as they are shown: texts and topics masked."""
    p = posts(spark, d).select("post_id", "original_text").join(details(spark, d).select("post_id", "topic"), "post_id", "left")
    return masked_record(p).filter("abusive").select("post_id", "original_text", "topic")


@query("""SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, CAST(length(s[1]) AS INTEGER) AS first_chars FROM (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM documents WHERE text IS NOT NULL)""")
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of each document and the length of the first."""
    s = table(spark, d, "documents").filter("text is not null").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.length(F.get("s", F.lit(0))).alias("first_chars"))


@query("""WITH r AS (SELECT DISTINCT CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day FROM events WHERE event_type = 'signup' AND user_id % 7 = 0), c AS (SELECT event_id, CAST(ts + INTERVAL 330 MINUTE AS DATE) AS day, extract(hour FROM ts + INTERVAL 330 MINUTE) AS h FROM events WHERE event_type = 'error')
SELECT event_id, c.day NOT IN (SELECT day FROM r) AND (h >= 9 OR coalesce((SELECT max(r.day) FROM r WHERE r.day < c.day) < c.day - 1, false)) AS due FROM c""")
def schedule_due(spark: SparkSession, d: str) -> DataFrame:
    """Whether a daily run is due: none yet that day and either nine o'clock has passed or a day before was missed.

    Days of runs are few; the newest before each is found by a window over them,
    and the rows meet it by an equi-join on the day.
    """
    e = table(spark, d, "events").withColumn("local", ist(F.col("ts"))).withColumn("day", F.to_date("local"))
    ran = e.filter("event_type = 'signup' and user_id % 7 = 0").select("day", F.lit(True).alias("ran")).distinct()
    days = e.select("day").distinct().join(ran, "day", "left")
    last = F.max(F.when(F.col("ran"), F.col("day"))).over(Window.partitionBy(F.lit(0)).orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = days.select("day", F.coalesce("ran", F.lit(False)).alias("ran"), last.alias("last"))
    missed = F.coalesce(F.col("last") < F.date_sub("day", 1), F.lit(False))
    return e.filter("event_type = 'error'").join(F.broadcast(days), "day").select("event_id", (~F.col("ran") & ((F.hour("local") >= 9) | missed)).alias("due"))


@query("""SELECT event_id, strftime(ts + INTERVAL 330 MINUTE, '%d %b %Y, %I:%M %p IST') AS report_label, strftime(ts + INTERVAL 330 MINUTE, '%d/%m %H:00') AS axis_label, strftime(date_trunc('day', ts) - INTERVAL 2 DAY, '%Y-%m-%d') AS window_start FROM events""")
def time_labels(spark: SparkSession, d: str) -> DataFrame:
    """Times as they are written on reports and axes, and the start of the window of two days before."""
    local = ist(F.col("ts"))
    start = F.date_trunc("day", "ts") - F.expr("INTERVAL 2 DAYS")
    return table(spark, d, "events").select("event_id", F.concat(F.date_format(local, "dd MMM yyyy, hh:mm a"), F.lit(" IST")).alias("report_label"), F.date_format(local, "dd/MM HH:00").alias("axis_label"), F.date_format(start, "yyyy-MM-dd").alias("window_start"))


# Addresses of every form, made of the tables' ids.
_FORMS = ["https://youtu.be/{v}", "https://www.youtube.com/watch?list=x&v={v}#t", "http://m.youtube.com/shorts/{v}?a=1", "https://youtube.com/@{c}/videos", "https://www.youtube.com/user/{c}", "https://evil.example/watch?v={v}", "https://youtube.com:444/watch?v={v}", "https://youtube.com/playlist?list={v}", "file:///{v}", "https://u@youtube.com/watch?v={v}", "https://127.0.0.1/watch?v={v}", "https://youtube.com/channel/UC{v}{v}"]
_MADE = " UNION ALL ".join("SELECT '" + f.replace("{v}", "' || v || '").replace("{c}", "' || c || '") + "' AS url FROM i" for f in _FORMS)
_PATH = "list_filter(string_split(regexp_extract(url, '^\\w+://[^/?#]+([^?#]*)', 1), '/'), lambda x: x <> '')"


@query(f"""WITH i AS (SELECT DISTINCT rpad(video_id, 11, 'x') AS v, channel_id AS c FROM videos), u AS ({_MADE}), h AS (SELECT url, lower(regexp_extract(url, '^\\w+://([^/?#]+)', 1)) AS host, {_PATH} AS p, regexp_extract(regexp_extract(url, '\\?([^#]*)', 1), '(?:^|&)v=([^&]*)', 1) AS v FROM u WHERE regexp_matches(url, '(?i)^https?://[^/?#@:]+(?:[/?#]|$)')),
r AS (SELECT *, CASE WHEN host LIKE '%youtu.be' THEN CASE WHEN len(p) = 1 THEN p[1] ELSE '' END WHEN p[1] = 'watch' THEN v WHEN p[1] IN ('shorts', 'live', 'embed') THEN coalesce(p[2], '') ELSE '' END AS raw FROM h WHERE host IN ('youtube.com', 'www.youtube.com', 'm.youtube.com', 'youtu.be', 'www.youtu.be')),
k AS (SELECT url, CASE WHEN regexp_matches(raw, '^[A-Za-z0-9_-]{{11}}$') THEN 'video' WHEN raw = '' AND regexp_matches(p[1], '^@[^\\s/?#%]+$') THEN 'handle' WHEN raw = '' AND p[1] = 'channel' AND regexp_matches(p[2], '^UC[A-Za-z0-9_-]{{22}}$') THEN 'channel' WHEN raw = '' AND p[1] = 'user' AND regexp_matches(p[2], '^[A-Za-z0-9_.-]{{1,100}}$') THEN 'user' END AS what, raw, p FROM r)
SELECT url, CASE WHEN what = 'video' THEN 'video' ELSE 'channel' END AS kind, CASE what WHEN 'handle' THEN 'handle' WHEN 'user' THEN 'user' ELSE 'id' END AS id_kind, CASE what WHEN 'video' THEN raw WHEN 'handle' THEN p[1] ELSE p[2] END AS id FROM k WHERE what IS NOT NULL""")
def url_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of videos and channels with what they name; foreign hosts, ports, users and playlists name nothing."""
    i = table(spark, d, "videos").select(F.rpad("video_id", 11, "x").alias("v"), F.col("channel_id").alias("c")).distinct()
    forms = F.array(*[F.replace(F.replace(F.lit(f), F.lit("{v}"), F.col("v")), F.lit("{c}"), F.coalesce("c", F.lit("{c}"))) for f in _FORMS])
    u = i.select("c", F.explode(forms).alias("url")).filter("not contains(url, '{c}')").select("url")
    r = urls.resolved(F.col("url"))
    return u.select("url", *[r[k].alias(k) for k in ("kind", "id_kind", "id")]).filter("kind is not null")


@query("SELECT v.video_id, 'https://www.youtube.com/watch?v=' || v.video_id || '&lc=' || url_encode(p.post_id) AS link FROM (SELECT DISTINCT metadata.video_id AS video_id, post_id FROM argus_post_details WHERE metadata.video_id IS NOT NULL) p JOIN (SELECT DISTINCT video_id FROM videos) v USING (video_id)")
def permalinks(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of the comments of known videos."""
    p = table(spark, d, "argus_post_details").select(F.col("metadata.video_id").alias("video_id"), "post_id").filter("video_id is not null").distinct()
    return p.join(table(spark, d, "videos").select("video_id").distinct(), "video_id").select("video_id", urls.permalink(F.col("video_id"), F.col("post_id")).alias("link"))


@query("SELECT post_id FROM (SELECT post_id, original_text, row_number() OVER (PARTITION BY post_id ORDER BY received_at DESC NULLS LAST, original_text DESC NULLS LAST) AS rn FROM post_inputs WHERE post_id IS NOT NULL) WHERE rn = 1 AND length(trim(original_text)) BETWEEN 1 AND 100 AND strlen(original_text) <= 160")
def input_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Inputs within bounds of characters and bytes; blank ones are out."""
    p = latest_by(table(spark, d, "post_inputs").select("post_id", "original_text", "received_at"), ["post_id"], "received_at", [F.col("original_text")])
    return p.filter(F.length(F.trim("original_text")).between(1, 100) & (F.octet_length("original_text") <= 160)).select("post_id")
