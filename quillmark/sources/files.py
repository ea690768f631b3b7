"""File scans: snapshots, CSV tables of audience shares, line files, binary media."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.math import half_up


def snapshot(spark: SparkSession, path: str, schema: T.StructType, kind: str = "json") -> DataFrame:
    """Rows of a snapshot, or an empty table of the schema where there is none yet."""
    try:
        reader = spark.read.schema(schema)
        return reader.option("multiLine", True).json(path) if kind == "json" else reader.format(kind).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with quoted cells and line breaks in them; headers in lower case, cells trimmed, blank rows skipped."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("\ufeff").strip().lower() for c in df.columns])
    df = df.select(*[F.trim(F.col(f"`{c}`")).alias(c) for c in df.columns])
    filled = [F.coalesce(F.length(F.col(f"`{c}`")), F.lit(0)) for c in df.columns]
    return df.filter(sum(filled, F.lit(0)) > 0)


def number(c: Column) -> Column:
    """A number in a cell; percent signs, commas and spaces are ignored."""
    return F.regexp_replace(c, r"[%,\s]", "").try_cast("double")


def age_label(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)^age[\s_]*", ""), r"(?i)\s*years?$", "")
    return F.regexp_replace(F.regexp_replace(c, "[_-]", "–"), "^65–?$", "65+")


# Labels of the gender dimension.
GENDERS = {"female": "Women", "male": "Men", "user_specified": "Self-described", "unknown": "Not stated"}


def gender_label(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in GENDERS.items() for x in kv])
    return F.coalesce(F.try_element_at(names, F.regexp_replace(F.lower(c), r"\s+", "_")), c)


def studio_shares(df: DataFrame) -> DataFrame:
    """``dimension``, ``label``, ``percent``, ``count`` of an exported audience table.

    The first header says the dimension; a percent column is taken as it is, a
    count column becomes a share of its sum. The total row is left out.
    """
    head = df.columns
    kind = next((d for d, words in (("age", ["age"]), ("gender", ["gender"]), ("country", ["geograph", "country"])) if any(w in head[0] for w in words)), None)
    share = next((c for c in head if c == "views (%)"), None) or next((c for c in head if c.startswith("watch time") and c.endswith("(%)")), None)
    metric = share or next((c for c in head if c == "views"), None)
    if kind is None or metric is None:
        raise ValueError("the table needs a dimension in its first column and a column of views")
    first = F.col(f"`{head[0]}`")
    label = {"age": age_label, "gender": gender_label, "country": lambda c: F.left(F.upper(c), F.lit(50))}[kind](first)
    rows = df.filter((first != "") & (F.lower(first) != "total")).select(F.lit(kind).alias("dimension"), label.alias("label"), number(F.col(f"`{metric}`")).alias("x")).filter("x is not null")
    if share:
        return rows.select("dimension", "label", half_up(F.col("x"), 2).alias("percent"), F.lit(None).cast("bigint").alias("count"))
    total = F.sum("x").over(Window.partitionBy("dimension"))
    return rows.select("dimension", "label", F.coalesce(half_up(F.try_divide(F.col("x"), total) * 100, 2), F.lit(0.0)).alias("percent"), F.floor(F.col("x") + 0.5).alias("count"))


def survey_shares(df: DataFrame) -> DataFrame:
    """Percent of each label within its dimension, from (dimension, label, count) rows."""
    rows = df.select(F.lower("dimension").alias("dimension"), F.left("label", F.lit(50)).alias("label"), F.floor(F.coalesce(number(F.col("count")), F.lit(0.0)) + 0.5).alias("count"))
    rows = rows.filter(F.col("dimension").isin("age", "gender", "country") & (F.length("label") > 0))
    total = F.sum("count").over(Window.partitionBy("dimension"))
    return rows.withColumn("percent", F.coalesce(half_up(F.try_divide(F.col("count") * 100.0, total), 2), F.lit(0.0)))


def commented_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file in which lines that start with ``//`` are comments; broken lines are left out."""
    lines = spark.read.text(path).filter((F.trim("value") != "") & ~F.trim("value").startswith("//"))
    row = F.from_json("value", schema)
    return lines.select(row.alias("r")).filter("r is not null").select("r.*")


def binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files with their content, found recursively."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


VALIDITY = "constraint string, dimension string, label string"


def share_violations(rows: DataFrame) -> DataFrame:
    """Broken constraints of an imported (dimension, label, percent[, count, suppressed]) table.

    Labels are short and hold no address, link, tag or control sign; percents are
    from 0 to 100 and null only where suppressed; counts are whole and not
    negative; labels differ beyond their case; a dimension has at most 20 rows and
    sums to 100.5 at most. All row checks are one pass.
    """
    label, said = F.col("label"), F.trim("label")
    checks = {
        "dimension": ~F.col("dimension").isin("age", "gender", "country"),
        "label": (F.length(said) == 0) | (F.length(label) > 50) | label.rlike(r"(?i)[@<>\r\n\x{0}-\x{1F}\x{200B}-\x{200F}]|https?:"),
        "percent": ~F.coalesce(F.col("percent").between(0, 100), F.lit(True)),
    }
    if "count" in rows.columns:
        checks["count"] = F.coalesce(F.col("count") < 0, F.lit(False)) | F.coalesce(F.col("count") != F.floor("count"), F.lit(False))
    if "suppressed" in rows.columns:
        checks["null percent"] = F.col("percent").isNull() & ~F.coalesce("suppressed", F.lit(False))
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()]))
    single = rows.select(F.explode(broken).alias("constraint"), "dimension", "label")
    again = rows.groupBy("dimension", F.lower(said).alias("label")).count().filter("count > 1").select(F.lit("repeated").alias("constraint"), "dimension", "label")
    per = rows.groupBy("dimension").agg(F.count("*").alias("n"), F.sum("percent").alias("s"))
    over = F.array_compact(F.array(F.when(F.col("n") > 20, F.lit("too many rows")), F.when(F.col("s") > 100.5, F.lit("more than all"))))
    whole = per.select(F.explode(over).alias("constraint"), "dimension", F.lit(None).cast("string").alias("label"))
    return single.unionByName(again).unionByName(whole)
