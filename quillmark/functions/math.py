"""Numeric and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column, digits: int) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d."""
    k = float(10**digits)
    return F.floor(c * k + 0.5) / k


def safe_count(c: Column) -> Column:
    """A counter: non-negative, at most 2^53 - 1, else null."""
    n = c.try_cast("bigint")
    return F.when((n >= 0) & (n <= 2**53 - 1), n)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays in double precision; JVM only."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column) -> Column:
    """The array scaled to length one; null where it has no length. The length is bound once, not for each element."""
    return F.transform(F.array(norm(a)), lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)))[0]


def exact_mean(c: Column, n: Column, digits: int) -> Column:
    """Aggregate: the sum of ``c`` over ``n``, rounded half away from zero, the same in whatever order the rows come.

    Sums of doubles depend on their order, so the mean of short decimals that ends
    in a 5 falls to either side. Here they are summed and divided as decimals of 18
    places. Only where a value isn't finite or is beyond 10 digits, doubles are summed.
    """
    d = c.try_cast("decimal(28,18)")
    fits = F.count(d) == F.count(c)
    exact = F.when(fits, F.try_divide(F.try_sum(d), n.cast("decimal(20,0)")))
    return F.coalesce(F.round(exact, digits).cast("double"), F.round(F.try_divide(F.sum(c), n.cast("double")), digits))


def hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)


def ist(ts: Column) -> Column:
    """Wall-clock time at UTC+5:30, which knows no summer time."""
    return ts + F.expr("INTERVAL 330 MINUTES")
