"""Table scans over a folder of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Scan ``folder/name.parquet``; columns and filters are pruned by Catalyst."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
