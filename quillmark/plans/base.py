"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators.latest import latest_by
from quillmark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def posts(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of every post. Ties are settled by narrow columns, so a text is only read where it is selected."""
    return latest_by(table(spark, d, "posts_nlp"), ["post_id"], "processed_at", [F.col("content_hash"), F.col("sentiment_score"), F.col("schema_version")])


def details(spark: SparkSession, d: str) -> DataFrame:
    """The latest state of every post's details, without its vector."""
    df = table(spark, d, "argus_post_details").select("post_id", "source", "source_url", "created_at", "metadata", "topic", "topic_source", "embedding_model", "updated_at")
    return latest_by(df, ["post_id"], "updated_at", [F.col("topic"), F.col("topic_source")])


# The same two as SQL.
POSTS = "p AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY processed_at DESC NULLS LAST, content_hash DESC NULLS LAST, sentiment_score DESC NULLS LAST, schema_version DESC NULLS LAST) AS rn FROM posts_nlp WHERE post_id IS NOT NULL) WHERE rn = 1)"
DETAILS = "a AS (SELECT * EXCLUDE (rn) FROM (SELECT post_id, source, source_url, created_at, metadata, topic, topic_source, updated_at, row_number() OVER (PARTITION BY post_id ORDER BY updated_at DESC NULLS LAST, topic DESC NULLS LAST, topic_source DESC NULLS LAST) AS rn FROM argus_post_details WHERE post_id IS NOT NULL) WHERE rn = 1)"
