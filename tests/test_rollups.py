"""Means that don't depend on the order of the rows."""

import glob
import math
import os

import duckdb
from pyspark.sql import functions as F

from quillmark.functions.math import exact_mean
from quillmark.plans import registry


def test_exact_mean(spark):
    kinds = {"tie": [0.1, 0.2, 0.3, -0.5998] + [0.0] * 12, "low": [-0.1, -0.2, -0.3, 0.5998] + [0.0] * 12, "none": [None, None], "nan": [1.0, math.nan], "inf": [1.0, math.inf], "huge": [1e300, 3e300], "small": [2e-7, None, 8e-7]}
    df = spark.createDataFrame([(k, x) for k, xs in kinds.items() for x in xs], "k string, x double").repartition(3)
    got = {r.k: r.m for r in df.groupBy("k").agg(exact_mean(F.col("x"), F.count("x"), 6).alias("m")).collect()}
    assert math.isnan(got.pop("nan"))
    assert got == {"tie": 1.3e-05, "low": -1.3e-05, "none": None, "inf": math.inf, "huge": 2e300, "small": 1e-06}


def test_topic_rollup_ties(spark, data):
    """The tables of sf0.01 have means that end in a 5 at the seventh place; all six places count."""
    d = data.replace("sf0.001", "sf0.01")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    want = con.execute(registry.oracle_sql()["topic_rollup"])
    names = [c[0] for c in want.description]
    got = registry.queries()["topic_rollup"](spark, d).select(*names).collect()
    assert {tuple(r) for r in got} == set(want.fetchall())
