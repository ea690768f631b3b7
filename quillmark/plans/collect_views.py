"""Collected pages and their joins, cache lookups, citations, staleness, written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.collect import cached, candidates, cited, hydrated, owned, stale
from quillmark.operators.latest import latest_by
from quillmark.plans.base import DETAILS, POSTS, details, posts, query
from quillmark.session import checkpoint_dir
from quillmark.sinks import files as sinks
from quillmark.sources.tables import table

_VIDEO = "v AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY fetched_at DESC NULLS LAST, view_count DESC NULLS LAST) AS rn FROM videos WHERE video_id IS NOT NULL) WHERE rn = 1)"


def _videos(spark: SparkSession, d: str) -> DataFrame:
    return latest_by(table(spark, d, "videos"), ["video_id"], "fetched_at", [F.col("view_count")])


@query(f"""WITH {DETAILS}, {_VIDEO}, c AS (SELECT source AS grp, metadata.video_id AS video_id, string_agg(DISTINCT metadata.content_kind, ' ' ORDER BY metadata.content_kind) AS discovered_by FROM a WHERE metadata.video_id IS NOT NULL GROUP BY 1, 2)
SELECT c.grp, c.video_id, c.discovered_by, v.channel_id, v.view_count FROM c JOIN v USING (video_id) WHERE (v.view_count > 100) IS DISTINCT FROM false AND v.channel_id IN (SELECT channel_id FROM channels)""")
def candidate_details(spark: SparkSession, d: str) -> DataFrame:
    """Candidate videos with all that found them, their details and a known channel; unjudged ones stay."""
    found = candidates(details(spark, d).select(F.col("source").alias("grp"), F.col("metadata.video_id").alias("video_id"), F.col("metadata.content_kind").alias("q")), "grp", "video_id", "q")
    info = _videos(spark, d).select("video_id", "channel_id", "view_count", (F.col("view_count") > 100).alias("relevant"))
    h = hydrated(found, info, "video_id", table(spark, d, "channels"), relevant="relevant")
    return h.select("grp", "video_id", F.array_join("discovered_by", " ").alias("discovered_by"), "channel_id", "view_count")


@query(f"""WITH {DETAILS}, {_VIDEO}, s AS (SELECT video_id, min(channel_id) AS channel_id FROM v WHERE channel_id IS NOT NULL GROUP BY 1) SELECT a.post_id, s.channel_id, c.channel_name, c.source_group FROM a LEFT JOIN s ON a.metadata.video_id = s.video_id LEFT JOIN (SELECT channel_id, any_value(channel_name) AS channel_name, any_value(source_group) AS source_group FROM channels GROUP BY 1) c USING (channel_id) WHERE a.metadata.video_id IS NOT NULL""")
def owner_map(spark: SparkSession, d: str) -> DataFrame:
    """Posts with the channel that was selected with their video, and its name and group."""
    lists = _videos(spark, d).filter("channel_id is not null").groupBy("channel_id").agg(F.collect_list("video_id").alias("video_ids"))
    names = table(spark, d, "channels").select("channel_id", "channel_name", "source_group")
    p = details(spark, d).select("post_id", F.col("metadata.video_id").alias("video_id")).filter("video_id is not null")
    return owned(p, lists).join(names, "channel_id", "left").select("post_id", "channel_id", "channel_name", "source_group")


_IN = "i AS (SELECT * EXCLUDE (rn) FROM (SELECT post_id, original_text, author_ref, source, received_at, row_number() OVER (PARTITION BY post_id ORDER BY received_at DESC NULLS LAST, original_text DESC NULLS LAST) AS rn FROM post_inputs WHERE post_id IS NOT NULL) WHERE rn = 1)"


def _inputs(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "post_inputs").select("post_id", "original_text", "author_ref", "source", "received_at")
    return latest_by(df, ["post_id"], "received_at", [F.col("original_text")])


@query(f"""WITH {_IN}, u AS (SELECT author_ref AS id, max(received_at) AS seen, any_value(source) FILTER (source IS NOT NULL) IS NOT NULL AS known FROM post_inputs WHERE author_ref LIKE '%1' GROUP BY 1) SELECT i.post_id, epoch_us(u.seen) AS author_seen_us FROM i LEFT JOIN u ON i.author_ref = u.id""")
def author_side_table(spark: SparkSession, d: str) -> DataFrame:
    """Posts with what a side table of authors says; authors it lacks leave nulls."""
    u = table(spark, d, "post_inputs").filter("author_ref like '%1'").groupBy(F.col("author_ref").alias("id")).agg(F.max("received_at").alias("seen"))
    return _inputs(spark, d).join(u, F.col("author_ref") == F.col("id"), "left").select("post_id", F.unix_micros("seen").alias("author_seen_us"))


@query(f"""WITH {_IN}, {POSTS}, c AS (SELECT sha256(CASE WHEN schema_version = '1.0.0' THEN 'v4:' || post_id || ':' || original_text ELSE 'v3:' || original_text END) AS key, min(sentiment_label) AS label FROM p WHERE original_text IS NOT NULL AND sentiment_label IS NOT NULL GROUP BY 1)
SELECT i.post_id, coalesce(x.label, y.label) AS label, CASE WHEN x.key IS NOT NULL THEN 1 WHEN y.key IS NOT NULL THEN 2 ELSE 0 END AS level FROM i LEFT JOIN c x ON x.key = sha256('v4:' || i.post_id || ':' || i.original_text) LEFT JOIN c y ON y.key = sha256('v3:' || i.original_text)""")
def cache_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Stored results by the current key, else by the older one that knows the text alone."""
    t = F.col("original_text")
    now, old = F.sha2(F.concat(F.lit("v4:"), "post_id", F.lit(":"), t), 256), F.sha2(F.concat(F.lit("v3:"), t), 256)
    p = posts(spark, d).filter("original_text is not null and sentiment_label is not null")
    cache = p.groupBy(F.when(F.col("schema_version") == "1.0.0", now).otherwise(old).alias("key")).agg(F.min("sentiment_label").alias("label"))
    return cached(_inputs(spark, d).select("post_id", "original_text"), cache, [now, old], "label").select("post_id", "label", "level")


@query(f"""WITH {POSTS}, e AS (SELECT post_id FROM p WHERE event_polarity = 'negative'), q AS (SELECT source, unnest(list_distinct([parent_id, post_id, parent_id])) AS cite FROM p WHERE parent_id IS NOT NULL) SELECT source, cite AS post_id, count(*) AS times FROM q WHERE cite IN (SELECT post_id FROM e) GROUP BY 1, 2""")
def valid_citations(spark: SparkSession, d: str) -> DataFrame:
    """What answers cite of the evidence they were given; a citation counts once for an answer."""
    p = posts(spark, d)
    a = p.filter("parent_id is not null").select("source", F.array("parent_id", "post_id", "parent_id").alias("cites"))
    return cited(a, p.filter("event_polarity = 'negative'"), "cites", "post_id").groupBy("source", "post_id").agg(F.count("*").alias("times"))


@query(f"""WITH a AS (SELECT * FROM (SELECT post_id, embedding_model, len(embedding) AS size, embedding IS NULL AS none, updated_at, row_number() OVER (PARTITION BY post_id ORDER BY updated_at DESC NULLS LAST, topic DESC NULLS LAST, topic_source DESC NULLS LAST) AS rn FROM argus_post_details WHERE post_id IS NOT NULL) WHERE rn = 1), {POSTS},
h AS (SELECT a.*, p.content_hash AS now, CASE WHEN p.schema_version = '1.0.0' THEN p.content_hash END AS stored FROM a LEFT JOIN p USING (post_id)), m AS (SELECT mode(embedding_model) AS m FROM argus_post_details WHERE embedding_model = 'argus-mini-384')
SELECT post_id, CASE WHEN none OR size <> 384 THEN 'length' WHEN embedding_model IS DISTINCT FROM 'argus-mini-384' THEN 'model' WHEN stored IS DISTINCT FROM now THEN 'text' END AS stale FROM h""")
def stale_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that must be made again and why; of the vectors only their length is read on."""
    df = table(spark, d, "argus_post_details").select("post_id", "topic", "topic_source", "embedding_model", F.when(F.size("embedding") >= 0, F.array_repeat(F.lit(True), F.size("embedding"))).alias("shape"), "updated_at")
    a = latest_by(df, ["post_id"], "updated_at", [F.col("topic"), F.col("topic_source")])
    j = a.join(posts(spark, d).select("post_id", "content_hash", "schema_version"), "post_id", "left")
    return stale(j, F.col("shape"), F.col("embedding_model"), "argus-mini-384", F.when(F.col("schema_version") == "1.0.0", F.col("content_hash")), F.col("content_hash")).select("post_id", "stale")


@query(f"WITH {POSTS}, k AS (SELECT * FROM p WHERE NOT (source = 'seed' OR starts_with(post_id, 'seed'))) SELECT (SELECT count(*) FROM k WHERE sentiment_label IS NOT NULL) AS results, (SELECT count(*) FROM k) AS details, CAST(0 AS INTEGER) AS errors, (SELECT count(*) FROM k WHERE sentiment_label IS NOT NULL) AS read_back, (SELECT count(*) FROM k) AS meant, (SELECT count(*) FROM k) AS found")
def persisted_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Write the corpus to its two tables twice, and a run once, and read them back: an upsert changes no number."""
    root = f"{checkpoint_dir(spark)}/quillmark/corpus-{uuid.uuid4().hex}"
    p = posts(spark, d).select("post_id", "source", "created_at", "sentiment_label", "sentiment_score")
    sinks.persist_corpus(p, ["sentiment_label", "sentiment_score"], ["source", "created_at"], root)
    s = sinks.persist_corpus(p, ["sentiment_label", "sentiment_score"], ["source", "created_at"], root)
    meant, found = sinks.persist_run("r1", p.select("post_id"), root)
    back = spark.read.parquet(f"{root}/results").count()
    return spark.createDataFrame([(s["results"], s["details"], len(s["errors"]), back, meant, found)], "results bigint, details bigint, errors int, read_back bigint, meant bigint, found bigint")


@query("SELECT n_nationkey, n_name FROM nation")
def json_lines_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A table written as lines of JSON and as one replaced file, read again."""
    path = f"{checkpoint_dir(spark)}/quillmark/lines-{uuid.uuid4().hex}"
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    sinks.json_lines(n.limit(1), path)
    sinks.json_lines(n, path)  # replaces what was there
    return spark.read.schema(n.schema).json(path)


@query(f"""WITH {DETAILS}, {POSTS}, r AS (SELECT a.topic, a.post_id, row_number() OVER (PARTITION BY a.topic ORDER BY coalesce(p.sentiment_confidence, 0) DESC, a.post_id) AS rn FROM a LEFT JOIN p USING (post_id) WHERE a.topic IS NOT NULL AND a.topic_source IN ('BERTopic', 'Embedding clusters')) SELECT topic, post_id, CAST(rn AS INTEGER) AS place FROM r WHERE rn <= 5""")
def representative_posts(spark: SparkSession, d: str) -> DataFrame:
    """Five posts of each clustered topic by probability, unknown ones as 0; the texts a summary would be asked for."""
    a = details(spark, d).filter(F.col("topic").isNotNull() & F.col("topic_source").isin("BERTopic", "Embedding clusters")).select("post_id", "topic")
    j = a.join(posts(spark, d).select("post_id", "sentiment_confidence"), "post_id", "left")
    w = Window.partitionBy("topic").orderBy(F.desc(F.coalesce("sentiment_confidence", F.lit(0.0))), "post_id")
    return j.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("topic", "post_id", "place")
