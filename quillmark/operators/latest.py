"""Last write wins: keep one row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], time: str, ties: list[Column] | None = None) -> DataFrame:
    """Keep the row with the greatest ``time`` for each key.

    Rows with a null time lose against any other. Rows that tie in ``time`` are
    ordered by ``ties``, greatest first. Rows with a null in a key are dropped:
    they cannot be addressed. ``row_number() == 1`` is turned by Spark into a
    group limit before the shuffle, so a hot key sends one row from each task.
    """
    order = [F.col(time).desc_nulls_last(), *[t.desc_nulls_last() for t in ties or []]]
    w = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.dropna(subset=keys)
        .withColumn("__rn", F.row_number().over(w))
        .filter("__rn = 1")
        .drop("__rn")
    )


#: Bits of a membership sieve, whatever it holds; it is broadcast as 8 MB of longs at most.
SIEVE_BITS = 1 << 26


def sieve(hashes: DataFrame, column: str = "h") -> DataFrame:
    """A sieve of some 64-bit hashes: ``chunk``, ``words``, of bounded size.

    What was put in is always found; other hashes are found too, the more often the
    fuller it is, so use it only where that costs work and not rightness.
    """
    bit = F.pmod(F.col(column), F.lit(SIEVE_BITS))
    b = hashes.select(F.shiftright(bit, 13).alias("chunk"), F.shiftright(bit, 6).bitwiseAND(127).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod({column}, 64) as int))").alias("one"))
    words = b.groupBy("chunk", "word").agg(F.bit_or("one").alias("bits")).groupBy("chunk").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    return words.select("chunk", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("bigint"))).alias("words"))


def sifted(df: DataFrame, hash_of: Column, held: DataFrame, name: str) -> DataFrame:
    """``df`` with the boolean ``name``: whether the hash may be in the sieve. Nothing of ``df`` is shuffled."""
    bit = F.pmod(F.col("__h"), F.lit(SIEVE_BITS))
    j = df.withColumn("__h", hash_of).withColumn("__c", F.shiftright(bit, 13)).join(F.broadcast(held.withColumnsRenamed({"chunk": "__c", "words": "__w"})), "__c", "left")
    word = F.get("__w", F.shiftright(bit, 6).bitwiseAND(127).cast("int"))
    hit = F.expr("shiftright(__word, cast(pmod(__h, 64) as int)) & 1") == 1
    return j.withColumn("__word", word).withColumn(name, F.coalesce(hit, F.lit(False))).drop("__h", "__c", "__w", "__word")


def latest_wide(df: DataFrame, keys: list[str], time: str, ties: list[Column] | None = None) -> DataFrame:
    """``latest_by`` for rows with large columns: only rows whose key occurs more than once are shuffled.

    Keys are counted first, from the key columns alone; the repeated ones are kept
    in a sieve of bounded size. Rows of other keys stay where they are read; the
    rest, and the few the sieve lets through besides, are settled by a window.
    """
    some = df.dropna(subset=keys)
    h = F.xxhash64(*keys)
    repeated = some.select(h.alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    marked = sifted(some, h, sieve(repeated), "__again")
    again = latest_by(marked.filter("__again").drop("__again"), keys, time, ties)
    return marked.filter("not __again").drop("__again").unionByName(again)
