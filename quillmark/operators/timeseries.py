"""As-of joins, sliding counts and view rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], at_least: str = "0 seconds", slice_seconds: int = 86_400) -> DataFrame:
    """Left rows with the ``values`` of the latest right row of the same key that is ``at_least`` as old.

    The two sides are put in one stream for each key and slice of time and swept
    once in time order, so a key of any size is spread over tasks by its slices;
    what the last right row was when a slice began is carried over by a window over
    one row for each key and slice. Nothing is multiplied. Rows of the left without
    an earlier right row get nulls. Right rows with null times are not used; left
    rows with a null time get nulls. Values come back as ``prior_<name>``, with
    ``prior_time``.
    """
    shift = F.expr(f"INTERVAL {at_least}")
    size = F.lit(slice_seconds * 1_000_000)
    part = lambda t: F.floor(F.unix_micros(t.cast("timestamp")) / size)
    payload = F.struct(F.col(right_time).alias("t"), *values)
    r = right.filter(F.col(right_time).isNotNull()).select(F.col(key).alias("__k"), (F.col(right_time) + shift).alias("__t"), F.lit(0).alias("__side"), payload.alias("__p"), F.lit(None).cast(left.schema).alias("__row"))
    lft = left.select(F.col(key).alias("__k"), F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(r.schema["__p"].dataType).alias("__p"), F.struct(*left.columns).alias("__row"))
    both = r.unionByName(lft).withColumn("__s", part(F.col("__t")))
    ends = both.filter("__s is not null").groupBy("__k", "__s").agg(F.max_by("__p", F.when(F.col("__side") == 0, F.struct("__t", "__p"))).alias("__end"))
    before = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("__k", "__s", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    w = Window.partitionBy("__k", "__s").orderBy(F.col("__t").asc_nulls_first(), "__side", F.col("__p").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("__prior", F.last("__p", ignorenulls=True).over(w)).filter("__side = 1").join(carried, ["__k", "__s"], "left")
    prior = swept.select("__row", F.when(F.col("__s").isNotNull(), F.coalesce("__prior", "__carry")).alias("__prior"))
    return prior.select("__row.*", F.col("__prior.t").alias("prior_time"), *[F.col(f"__prior.{v}").alias(f"prior_{v}") for v in values])


def trailing_count(df: DataFrame, keys: list[str], time: str, seconds: int, name: str) -> DataFrame:
    """Rows of the same keys in the trailing window that ends with each row, itself included.

    A key is cut into slices of time, each with the rows of one window before it,
    so a key of any size is counted by many tasks. Rows without a time count the
    rows of their key without one.
    """
    span, size = seconds * 1_000_000, max(16 * seconds, 3600) * 1_000_000
    at = F.unix_micros(time)
    own = F.floor(at / size)
    follows = F.when(at > (own + 1) * size - span, F.array(own, own + 1)).otherwise(F.array(own))
    rows = df.withColumns({"__at": at, "__own": own}).withColumn("__s", F.explode(F.coalesce(follows, F.array(F.lit(None).cast("bigint")))))
    w = Window.partitionBy(*keys, "__s").orderBy("__at").rangeBetween(-span + 1, 0)
    return rows.withColumn(name, F.count("*").over(w)).filter(F.col("__s").eqNullSafe(F.col("__own"))).drop("__at", "__own", "__s")


def running_sum(df: DataFrame, keys: list[str], time: str, tie: str, value: str, name: str, slice_of: str = "day") -> DataFrame:
    """Running sum of a value for each key in order of time, in two levels: within a slice, and over the slices' sums."""
    rows = df.withColumn("__s", F.date_trunc(slice_of, time))
    sums = rows.groupBy(*keys, "__s").agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*keys, "__s", F.coalesce(F.sum("__sum").over(before), F.lit(0.0)).alias("__carry"))
    w = Window.partitionBy(*keys, "__s").orderBy(time, tie).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("__in", F.sum(value).over(w)).join(carried, [*keys, "__s"]).withColumn(name, F.coalesce("__in", F.lit(0.0)) + F.col("__carry")).drop("__s", "__in", "__carry")


def view_rate(views: Column, prior_views: Column, prior_time: Column, published: Column, now: Column) -> tuple[Column, Column]:
    """Views an hour and their basis.

    Growth since the prior observation if there is one; a negative growth is a
    correction of the counter and gives null; else views over age, an hour at
    least; null without views.
    """
    hours = (F.unix_micros(now) - F.unix_micros(prior_time)) / F.lit(3.6e9)
    age = (F.unix_micros(now) - F.unix_micros(published)) / F.lit(3.6e9)
    growth = views - prior_views
    basis = F.when(views.isNull(), "unavailable").when(prior_views.isNotNull() & (growth < 0), "counter_correction").when(prior_views.isNotNull(), "observed_growth").when(age >= 0, "initial_estimate").otherwise("unavailable")
    rate = F.when(basis == "observed_growth", F.try_divide(growth.cast("double"), hours)).when(basis == "initial_estimate", views / F.greatest(age, F.lit(1.0)))
    return rate, basis
