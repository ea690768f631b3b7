"""Sinks. Writes go through the commit protocol, so a reader never sees half of one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.latest import latest_by
from quillmark.plans.post_views import without_seeds
from quillmark.session import cut


def overwrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace a table as a whole."""
    df.write.mode("overwrite").format(kind).save(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line in UTF-8, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", False).option("encoding", "UTF-8").json(path)


def upsert(df: DataFrame, path: str, keys: list[str]) -> int:
    """Merge rows into a Parquet table by key, the new ones winning; returns how many rows came.

    The merged table is written beside the old one and takes its place only when
    it is whole.
    """
    spark = df.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    target, other = fs_path(path), fs_path(path.rstrip("/") + ".next")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    new = df.withColumn("__new", F.lit(1))
    whole = new.unionByName(spark.read.parquet(path).withColumn("__new", F.lit(0)), allowMissingColumns=True) if fs.exists(target) else new
    latest_by(whole, keys, "__new").drop("__new").write.mode("overwrite").parquet(other.toString())
    if fs.exists(target):
        fs.delete(target, True)
    fs.rename(other, target)
    return df.count()


def persist_corpus(posts: DataFrame, results: list[str], details: list[str], root: str, key: str = "post_id") -> dict:
    """Write posts to two tables by key, seeds left out: results where they are there, details of all.

    An error in one table is reported and does not keep the other from being
    written: ``{"results": n, "details": n, "errors": [...]}``.
    """
    own = cut(without_seeds(posts))  # read once for both tables
    status: dict = {"results": 0, "details": 0, "errors": []}
    for name, cols, rows in (("results", results, own.filter(F.col(results[0]).isNotNull())), ("details", details, own)):
        try:
            status[name] = upsert(rows.select(key, *cols), f"{root}/{name}", [key])
        except Exception as e:  # noqa: BLE001 - reported, as the contract says
            status["errors"].append(f"{name}: {str(e)[:200]}")
    return status


def persist_run(run_id: str, posts: DataFrame, root: str, key: str = "post_id") -> tuple[int, int]:
    """Write an immutable run and read it back: rows meant, and of them rows found."""
    path = f"{root}/records/run_id={run_id}"
    posts.write.mode("errorifexists").parquet(path)
    there = posts.sparkSession.read.parquet(path).select(key)
    meant = posts.select(key).distinct()
    return meant.count(), meant.join(there, key, "left_semi").count()
