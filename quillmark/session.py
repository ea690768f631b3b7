"""Session helpers: shared checkpoint folder, table cutting, package shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Whether the shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named in ``spark.checkpoint.dir``.

    Only where the session names none (tests, a laptop) a local folder is set.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = now.get() if now.isDefined() else None
    if where is None:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back.

    Columnar, so later passes read only the columns they need; survives the loss
    of any executor. The shuffle files it took are removed as soon as it is
    written: left to the driver's garbage collector, each step of a long job would
    add its files to those of the steps before.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables, below the shared folder only, that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        own = f"{checkpoint_dir(spark)}/quillmark/".split(":", 1)[-1].replace("//", "/")
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            if own in folder.replace("//", "/"):
                where = spark._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable on every executor (once for a session)."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or getattr(sc, "_quillmark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="quillmark-pkg-")
    target = os.path.join(folder, "quillmark_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"quillmark/{p.relative_to(root)}")
    sc.addPyFile(target)
    sc._quillmark_shipped = True
