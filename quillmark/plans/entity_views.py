"""Dictionary entities of posts: counts, search, civic filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.operators.gazetteer import GAZETTEER, civic, entities, merged, sql_hits
from quillmark.plans.base import POSTS, posts, query

#: The fixed names with some of the corpus at hand, which invents its places.
TERMS = merged(GAZETTEER, {"LOC": ["ration shop", "bus shelter", "night market", "school road", "ward", "temple"], "ORG": ["job portal", "health centre", "council"]})

_LISTS = " ".join(f"UNION ALL BY NAME SELECT post_id, seen, '{label}' AS label, {i} AS grp, {sql_hits('original_text', words)} AS l FROM q" for i, (label, words) in enumerate(TERMS.items()))[len("UNION ALL BY NAME "):]
_ENTITIES = f"""WITH {POSTS}, q AS (SELECT post_id, original_text, epoch_us(created_at) AS seen FROM p WHERE original_text IS NOT NULL), l AS ({_LISTS}), e AS (SELECT post_id, seen, label, grp, unnest(l) AS text, generate_subscripts(l, 1) AS i FROM l)"""


def _found(spark: SparkSession, d: str) -> DataFrame:
    return posts(spark, d).filter("original_text is not null").select("post_id", F.unix_micros("created_at").alias("seen"), entities(F.col("original_text"), TERMS).alias("found"))


@query(f"{_ENTITIES} SELECT post_id, label, text, count(*) AS n FROM e GROUP BY ALL")
def post_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities of every post as they are written, with their number."""
    e = _found(spark, d).select("post_id", F.explode("found").alias("e"))
    return e.groupBy("post_id", F.col("e.label").alias("label"), F.col("e.text").alias("text")).agg(F.count("*").alias("n"))


@query(f"""{_ENTITIES}, c AS (SELECT label, lower(text) AS k, count(*) AS n, first(text ORDER BY seen NULLS LAST, post_id, i) AS text FROM e WHERE label IN ('GPE', 'LOC', 'ORG') GROUP BY 1, 2)
SELECT label, text, n, CAST(row_number() OVER (ORDER BY n DESC, label, k) AS INTEGER) AS place FROM c""")
def entity_counts_casefold(spark: SparkSession, d: str) -> DataFrame:
    """Civic entities by label whatever their case, shown as first seen, most frequent first."""
    e = _found(spark, d).select("post_id", "seen", F.posexplode(civic(F.col("found"))).alias("i", "e"))
    first = F.min_by("e.text", F.struct(F.col("seen").isNull(), "seen", "post_id", "i"))
    c = e.groupBy(F.col("e.label").alias("label"), F.lower("e.text").alias("k")).agg(F.count("*").alias("n"), first.alias("text"))
    return c.select("label", "text", "n", F.row_number().over(Window.orderBy(F.desc("n"), "label", "k")).alias("place"))


@query(f"{_ENTITIES} SELECT DISTINCT post_id FROM e WHERE lower(text) IN ('ward', 'night market')")
def entity_search(spark: SparkSession, d: str) -> DataFrame:
    """Posts in which one of some entities exists."""
    return _found(spark, d).filter(F.exists("found", lambda e: F.lower(e["text"]).isin("ward", "night market"))).select("post_id")


@query(f"{_ENTITIES} SELECT text AS k, count(DISTINCT post_id) AS posts FROM (SELECT lower(text) AS text, post_id FROM e) GROUP BY 1")
def entities_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Posts by entity text alone, whatever the label."""
    e = _found(spark, d).select("post_id", F.explode(F.array_distinct(F.transform("found", lambda x: F.lower(x["text"])))).alias("k"))
    return e.groupBy("k").agg(F.count("*").alias("posts"))
