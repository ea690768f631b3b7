"""Upserts, retention and incremental reuse over orders and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.merge import last_write_wins, newest, reuse
from quillmark.plans.base import query
from quillmark.sources.tables import table


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 24""")
def retention_newest_n(spark: SparkSession, d: str) -> DataFrame:
    """The 24 newest orders of each customer."""
    return newest(table(spark, d, "orders"), ["o_custkey"], "o_orderdate", 24, "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'closed' ELSE o_orderstatus END AS status FROM orders""")
def last_write_wins_union(spark: SparkSession, d: str) -> DataFrame:
    """Keyed union of a table and a later one with some changed rows."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    return last_write_wins([o, o.filter("status = 'F'").withColumn("status", F.lit("closed"))], ["o_orderkey"])


_OLD = "o AS (SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE text || ' old' END AS text, n_chars AS result FROM documents WHERE content_kind <> 'note')"


@query(f"""WITH {_OLD} SELECT d.doc_id, CASE WHEN o.doc_id IS NOT NULL AND o.text IS NOT DISTINCT FROM d.text AND o.result IS NOT NULL THEN o.result END AS result, NOT (o.doc_id IS NOT NULL AND o.text IS NOT DISTINCT FROM d.text AND o.result IS NOT NULL) AS todo FROM documents d LEFT JOIN o USING (doc_id)""")
def incremental_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Results are kept where the text is unchanged; the rest is to do."""
    new = table(spark, d, "documents").select("doc_id", "text")
    old = table(spark, d, "documents").filter("content_kind <> 'note'").select("doc_id", F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat("text", F.lit(" old"))).alias("text"), F.col("n_chars").alias("result"))
    return reuse(new, old, "doc_id", "text", ["result"]).select("doc_id", "result", "todo")


@query("SELECT p.post_id FROM (SELECT DISTINCT post_id FROM post_inputs WHERE post_id IS NOT NULL) p WHERE p.post_id NOT IN (SELECT post_id FROM posts_nlp WHERE post_id IS NOT NULL)")
def todo_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Posts that were scraped and not yet processed."""
    return table(spark, d, "post_inputs").select("post_id").dropna().distinct().join(table(spark, d, "posts_nlp").select("post_id"), "post_id", "left_anti")


@query("SELECT count(DISTINCT i.post_id) AS present FROM post_inputs i WHERE i.post_id IN (SELECT post_id FROM posts_nlp)")
def verify_written(spark: SparkSession, d: str) -> DataFrame:
    """How many written keys are found in the store."""
    return table(spark, d, "post_inputs").select("post_id").distinct().join(table(spark, d, "posts_nlp").select("post_id"), "post_id", "left_semi").agg(F.count("*").alias("present"))
