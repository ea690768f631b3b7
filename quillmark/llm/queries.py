"""Registered queries of the training-data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmark.session import materialise
from quillmark.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillmark.llm.neighbours import neighbours
    from quillmark.llm.vectors import usable_vectors

    n = neighbours(*usable_vectors(table(spark, d, "argus_post_details")), own=True)
    return n.select(F.least("key", "neighbour").alias("post_id_a"), F.greatest("key", "neighbour").alias("post_id_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.neighbours import neighbours
    from quillmark.llm.vectors import usable_vectors

    found = neighbours(*usable_vectors(table(spark, d, "argus_post_details")), fill=True, own=True)
    return found.withColumnsRenamed({"key": "post_id", "neighbour": "neighbour_id"})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.language import label_faults, languages

    found = languages(table(spark, d, "post_inputs"), "post_id", "original_text", "received_at", "lang_hint")
    # Read once, used by three kinds of fault.
    once = materialise(found.select("post_id", "lang", "mixed", "langs", "label_code"), "languages")
    return label_faults(once, table(spark, d, "language_info"))


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.language import languages

    found = languages(table(spark, d, "post_inputs"), "post_id", "original_text", "received_at", "lang_hint")
    return found.select("post_id", "lang", "confidence", "mixed", "segments")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.abuse import LEAST, scored

    return scored(table(spark, d, "posts_nlp"), "post_id", "original_text", "processed_at").filter(f"score >= {LEAST}").select("post_id")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.abuse import rates, scored

    return rates(scored(table(spark, d, "posts_nlp"), "post_id", "original_text", "processed_at", "source"), "source")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.format_dups import format_duplicates

    m = format_duplicates(table(spark, d, "posts_nlp"), "post_id", "original_text", "processed_at")
    return m.filter("post_id <> first_post_id").select("first_post_id", "post_id")


def p4_kept_posts(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.format_dups import format_duplicates, kept_posts

    return kept_posts(format_duplicates(table(spark, d, "posts_nlp"), "post_id", "original_text", "processed_at"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.lookalike import form_digests, same_look_pairs

    digests = form_digests(table(spark, d, "posts_nlp"), "post_id", "original_text", "processed_at")
    return same_look_pairs(materialise(digests, "digests"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.lookalike import form_digests, look_groups

    digests = form_digests(table(spark, d, "posts_nlp"), "post_id", "original_text", "processed_at")
    return look_groups(materialise(digests, "digests"))


def p5_consistent_text(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.lookalike import consistent_text

    return consistent_text(table(spark, d, "posts_nlp"), "post_id", "original_text", "processed_at").select("post_id", "consistent_text")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.clusters import clusters
    from quillmark.llm.vectors import usable_vectors

    return materialise(clusters(*usable_vectors(table(spark, d, "argus_post_details"), extra="topic")), "clusters")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.clusters import topics

    members = _clusters(spark, d)
    return members.join(topics(members), ["cluster", "model"]).selectExpr("key as post_id", "topic")


def p6_clusters(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.clusters import described

    return described(_clusters(spark, d))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillmark.llm.pii import found_types

    inputs = found_types(table(spark, d, "post_inputs"), "post_id", "original_text", "received_at").withColumn("table_name", F.lit("post_inputs"))
    nlp = found_types(table(spark, d, "posts_nlp"), "post_id", "original_text", "processed_at").withColumn("table_name", F.lit("posts_nlp"))
    return inputs.unionByName(nlp).select("table_name", "post_id", "pii_type")


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillmark.llm.pii import personal_data

    times = {"post_inputs": "received_at", "posts_nlp": "processed_at"}
    a, b = (personal_data(table(spark, d, t), "post_id", "original_text", at).select(F.lit(t).alias("table_name"), "post_id", "redacted_text", F.size("finds").alias("finds")) for t, at in times.items())
    return a.unionByName(b)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.leakage import leaks

    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.leakage import leaked_items, leaks

    return leaked_items(leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.mixing import mix

    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.mixing import mix, reached_shares

    targets = table(spark, d, "mix_targets")
    return reached_shares(mix(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    from quillmark.llm.residue import residue

    return residue(table(spark, d, "documents")).filter("residue").select("doc_id")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit() and callable(f)}
