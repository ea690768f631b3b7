"""Duplicates flagged in a stream."""

import time

from pyspark.sql import functions as F

from quillmark.streaming import jobs


def test_flags_across_batches(spark, tmp_path):
    """Four batches; the first batch with a key has its first row, whatever the times; null keys, times and rows count."""
    batches = [
        [("a", 3, 30), ("a", 2, 10), ("b", 1, 5), (None, 4, 1)],
        [("a", 5, 1), ("c", 7, None), ("c", 6, 9), (None, 8, 0)],
        [("d", None, 5), ("d", 9, 5), ("b", 10, 7)],
        [("d", 11, 0), ("c", 12, 0)],
    ]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "k string, id bigint, at bigint").withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
        time.sleep(1.1)  # files are taken in order of their times
    got = {(r.id, r.is_duplicate) for r in jobs.flagged(jobs.stream(spark, str(tmp_path / "t"), files_at_once=1), "k", "id", "at").collect()}
    assert got == {(3, True), (2, False), (1, False), (4, False), (5, True), (7, True), (6, False), (8, True), (None, True), (9, False), (10, True), (11, True), (12, True)}


def test_flags_without_python_for_each_key(spark, tmp_path):
    """As many keys as rows: in a minute where a call of Python for each key took several."""
    spark.range(1_000_000).select(F.col("id"), (F.col("id") % 900_000).cast("string").alias("k"), F.timestamp_seconds("id").alias("at")).coalesce(1).write.parquet(str(tmp_path / "t"))
    began = time.time()
    got = jobs.flagged(jobs.stream(spark, str(tmp_path / "t")), "k", "id", "at").groupBy("is_duplicate").count().collect()
    assert {r.is_duplicate: r["count"] for r in got} == {False: 900_000, True: 100_000}
    assert time.time() - began < 60
