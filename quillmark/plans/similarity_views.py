"""Vector queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.math import dot
from quillmark.operators.similarity import centroids, communities, nearest_centroid, pairs_above, top_similar, trigram_vectors
from quillmark.plans.base import query
from quillmark.sources.tables import table

_C = """s AS (SELECT label, i AS pos, sum(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, range(1, 65) t(i) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(x * x)) AS len FROM s GROUP BY label), c AS (SELECT label, list(x / len ORDER BY pos) AS centroid FROM s JOIN n USING (label) GROUP BY label)"""


def _e(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], e), 6) AS similarity FROM embeddings, q ORDER BY list_dot_product(embedding::DOUBLE[], e) DESC, vec_id LIMIT 70""")
def vector_topk_70(spark: SparkSession, d: str) -> DataFrame:
    first = _e(spark, d).filter("vec_id = 0").select("embedding").first()
    return top_similar(_e(spark, d), "vec_id", "embedding", list(first[0]) if first else [0.0]).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_C} SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(centroid[i], 6) AS x FROM c, range(1, 65) t(i)")
def topic_centroids(spark: SparkSession, d: str) -> DataFrame:
    return centroids(_e(spark, d), "label", "embedding").select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 6).alias("x"))


@query(f"""WITH {_C}, m AS (SELECT vec_id, c.label, list_dot_product(embedding::DOUBLE[], centroid) AS s FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS rn, lead(s) OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS second FROM m)
SELECT vec_id, CASE WHEN s >= 0.2 AND (second IS NULL OR s - second >= 0.05) THEN label END AS label, round(s, 6) AS similarity FROM r WHERE rn = 1""")
def nearest_centroid_margin(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    return nearest_centroid(e, "vec_id", "embedding", centroids(e, "label", "embedding"), "label", 0.2, 0.05).select("vec_id", "label", F.round("similarity", 6).alias("similarity"))


@query("""SELECT x.vec_id AS a, y.vec_id AS b, round(list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_dot_product(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.3""")
def similarity_pairs_threshold(spark: SparkSession, d: str) -> DataFrame:
    return pairs_above(_e(spark, d), "vec_id", "embedding", 0.3).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_C}, m AS (SELECT vec_id, label, list_dot_product(embedding::DOUBLE[], centroid) AS s FROM embeddings JOIN c USING (label)), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY s DESC, vec_id) AS rn FROM m) SELECT label, vec_id, CAST(rn AS INTEGER) AS place FROM r WHERE rn <= 5""")
def representative_top5(spark: SparkSession, d: str) -> DataFrame:
    e = _e(spark, d)
    s = e.join(centroids(e, "label", "embedding"), "label").select("label", "vec_id", dot(F.col("embedding"), F.col("centroid")).alias("s"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("s"), "vec_id"))).filter("place <= 5").select("label", "vec_id", "place")


@query()
def greedy_communities(spark: SparkSession, d: str) -> DataFrame:
    return communities(_e(spark, d), "label", "vec_id", "embedding", 0.25)


@query()
def ngram_tfidf_vectors(spark: SparkSession, d: str) -> DataFrame:
    return trigram_vectors(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")
