"""Structured Streaming forms of the polling jobs and small state machines."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.operators.latest import latest_by
from quillmark.session import checkpoint_dir


def stream(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """A stream over the Parquet files of a path, with an event time of timestamp type."""
    known = spark.read.parquet(path)
    reader = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", files_at_once)
    folder, _, name = path.rstrip("/").rpartition("/")
    if any(f.endswith(f"/{name}") for f in known.inputFiles()[:1]):  # a single file: a stream reads its folder
        reader, path = reader.option("pathGlobFilter", name), folder
    df = reader.parquet(path)
    for c, kind in df.dtypes:
        if kind == "timestamp_ntz":
            df = df.withColumn(c, F.col(c).cast("timestamp"))
    return df


def drain(df: DataFrame, mode: str, merge: Callable[[DataFrame], DataFrame] | None = None, each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there and read its result.

    Each batch is written with its number, so a batch that is run again after a
    failure replaces its own output. ``each`` is applied to every batch before it
    is written, ``merge`` reduces what several batches wrote.
    """
    spark = df.sparkSession
    root = f"{checkpoint_dir(spark)}/quillmark/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        (each(batch) if each else batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{root}/out/n={number}")

    q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    schema = (each(df) if each else df).withColumn("batch", F.lit(0)).schema
    out = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{root}/out")
    return merge(out).drop("batch") if merge else out.drop("batch")


def hourly(events: DataFrame, time: str, value: str, late: str = "2 days") -> DataFrame:
    """Count and mean of each hour; rows later than ``late`` are left out."""
    w = F.window(time, "1 hour")
    return events.withWatermark(time, late).groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean_value")).select(F.col("w.start").alias("hour"), "n", "mean_value")


def newest_update(keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """For each key what the last batch wrote."""
    return lambda out: latest_by(out, keys, "batch")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "2 days") -> DataFrame:
    """The first row of each key within the watermark; state older than it is dropped."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, key: str, time: str, seconds: int = 60, limit: int = 20) -> DataFrame:
    """Windows of a key that hold more than ``limit`` rows; rejected rows count too."""
    w = F.window(time, f"{seconds} seconds", f"{max(1, seconds // 6)} seconds")
    return events.withWatermark(time, "1 hour").groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).filter(F.col("n") > limit).select(key, F.col("w.start").alias("since"), "n")


#: Minutes after which a waiting review expires.
REVIEW_SECONDS = 600


def review_step(state: tuple[str, int] | None, verdict: str, at: int) -> tuple[str, int]:
    """Next state of a review: (status, since, in epoch seconds).

    unsure and ask wait, severe is flagged and never approvable; a waiting review
    expires after ``REVIEW_SECONDS``; a resolved one stays as it is.
    """
    if state is None:
        return ("flagged" if verdict == "severe" else "waiting" if verdict in ("unsure", "ask") else "approved", at)
    status, since = state
    if status == "waiting" and at - since > REVIEW_SECONDS:
        return "expired", since + REVIEW_SECONDS
    if status == "waiting" and verdict in ("approve", "uphold"):
        return ("approved" if verdict == "approve" else "upheld", at)
    if status == "flagged" and verdict == "uphold":
        return "upheld", at
    return status, since


def reviews(events: DataFrame, key: str, verdict: str, time: str) -> DataFrame:
    """Status of each review as of its last event, kept in state with an event-time timeout."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: Any = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            status = "expired" if now and now[0] == "waiting" else now[0]
            yield pd.DataFrame({key: [k[0]], "status": [status], "since": [now[1]]})
            return
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        for v, t in zip(rows[verdict], rows[time]):
            now = review_step(now, v, int(t.timestamp()))
        state.update(now)
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(mark + 1, (now[1] + REVIEW_SECONDS) * 1000 + 1))
        yield pd.DataFrame({key: [k[0]], "status": [now[0]], "since": [now[1]]})

    kind = dict(events.dtypes)[key]
    return events.withWatermark(time, "1 hour").select(key, verdict, time).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, status string, since bigint", "status string, since bigint", "update", GroupStateTimeout.EventTimeTimeout)


def upsert_batches(events: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Incremental merge: the latest row of each key over all batches, the same when a batch is run again."""
    return drain(events, "append", lambda out: latest_by(out, keys, time, [F.col("batch")]))


def stateful(events: DataFrame, key: str, time: str, order: list[str], out: str, state: str, step: Callable[[tuple | None, dict], tuple[tuple, dict | None]], late: str = "1 hour", keep_ms: int | None = None) -> DataFrame:
    """Rows of each key through a state, in order of time: ``step(state, row) -> (state, output or None)``.

    ``out`` and ``state`` are schemas. Where ``keep_ms`` is given the state of a key
    is dropped once the watermark is that much beyond its last row.
    """
    names = [x.split()[0] for x in out.split(", ")]

    def run(k: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        now: Any = tuple(held.get) if held.exists else None
        made = []
        rows = pd.concat(list(frames)).sort_values([time, *order], kind="stable")
        for row in rows.to_dict("records"):
            now, got = step(now, row)
            if got is not None:
                made.append(got)
        if now is not None:
            held.update(now)
            if keep_ms is not None:
                held.setTimeoutTimestamp(max(held.getCurrentWatermarkMs() + 1, int(rows[time].max().timestamp() * 1000) + keep_ms))
        if made:
            yield pd.DataFrame(made, columns=names)

    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.EventTimeTimeout
    return events.withWatermark(time, late).groupBy(key).applyInPandasWithState(run, out, state, "append", timeout)


def flagged(events: DataFrame, key: str, row: str, time: str) -> DataFrame:
    """``row``, ``is_duplicate``: every row stays; all but the first of its key are flagged, across batches.

    The keys seen so far are the state of a deduplication. It gives one mark for each
    new key of a batch, which is put before the rows of that key; the row that
    follows a mark is the first. No Python runs for a key, of which there may be
    nearly as many as rows.
    """
    rows = events.select(F.col(key).alias("key"), F.col(row).alias("row"), F.col(time).alias("at"))
    marks = rows.select("key").dropDuplicates(["key"]).select("key", F.lit(None).cast(dict(rows.dtypes)["row"]).alias("row"), F.lit(None).cast(dict(rows.dtypes)["at"]).alias("at"), F.lit(True).alias("new"))
    order = Window.partitionBy("key").orderBy(F.desc("new"), F.col("at").asc_nulls_last(), F.col("row").asc_nulls_last())

    def flag(batch: DataFrame) -> DataFrame:
        after = batch.withColumn("first", F.coalesce(F.lag("new").over(order), F.lit(False)))
        return after.filter("not new").select(F.col("row").alias(row), (~F.col("first")).alias("is_duplicate"))

    return drain(rows.withColumn("new", F.lit(False)).unionAll(marks), "append", each=flag)


def budgeted(events: DataFrame, key: str, row: str, cost: str, time: str, budget: float) -> DataFrame:
    """``row``, ``spent``, ``exhausted``: the running cost of each key and whether its budget is used up; it never is given back."""
    kind = dict(events.dtypes)[row]

    def step(s: tuple | None, r: dict) -> tuple[tuple, dict]:
        spent = (s[0] if s else 0.0) + (0.0 if pd.isna(r[cost]) else float(r[cost]))
        return (spent,), {row: r[row], "spent": spent, "exhausted": spent >= budget}

    return stateful(events.select(key, row, cost, time), key, time, [row], f"{row} {kind}, spent double, exhausted boolean", "spent double", step)


def cached_answers(events: DataFrame, key: str, row: str, time: str, seconds: int = 3600) -> DataFrame:
    """``row``, ``hit``: whether an answer for the key was made at most ``seconds`` before; a miss makes one. State older than that is dropped."""
    kind = dict(events.dtypes)[row]

    def step(s: tuple | None, r: dict) -> tuple[tuple, dict]:
        at = int(r[time].timestamp() * 1_000_000)
        hit = s is not None and at - s[0] <= seconds * 1_000_000
        return (s if hit else (at,)), {row: r[row], "hit": hit}

    return stateful(events.select(key, row, time), key, time, [row], f"{row} {kind}, hit boolean", "made bigint", step, keep_ms=seconds * 1000 + 1)


def trailing_distinct(events: DataFrame, key: str, row: str, text: str, time: str, days: int = 7) -> DataFrame:
    """``row``, ``n``: distinct texts of the key first seen in the trailing days; a text that is repeated within them adds no row."""
    kind = dict(events.dtypes)[row]
    span = days * 86_400_000_000

    def step(s: tuple | None, r: dict) -> tuple[tuple, dict | None]:
        at = int(r[time].timestamp() * 1_000_000)
        seen = {t: a for t, a in zip(*s) if at - a < span} if s else {}
        if str(r[text]) in seen:
            return (list(seen), list(seen.values())), None
        seen[str(r[text])] = at
        return (list(seen), list(seen.values())), {row: r[row], "n": len(seen)}

    return stateful(events.select(key, row, text, time), key, time, [row], f"{row} {kind}, n bigint", "texts array<string>, at array<bigint>", step, keep_ms=days * 86_400_000 + 1)


def reused(stream_: DataFrame, old: DataFrame, key: str, text: str, time: str, result: str) -> DataFrame:
    """Incremental processing: stream rows with the stored result where the text is unchanged; the newest of each key counts."""
    side = old.select(F.col(key).alias("__k"), F.col(text).alias("__t"), F.col(result).alias("__r"))
    j = stream_.join(side, stream_[key] == side["__k"], "left")
    same = F.col("__k").isNotNull() & F.col("__t").eqNullSafe(F.col(text)) & F.col("__r").isNotNull()
    out = j.select(key, time, text, F.when(same, F.col("__r")).alias(result), (~same).alias("todo"))
    return drain(out, "append", lambda o: latest_by(o, [key], time, [F.col(text), F.col("batch")]))


def run_every(df: DataFrame, write: Callable[[DataFrame, int], None], log: str, every: str | None = None):  # noqa: ANN201
    """Start a stream with a polling interval, or, without one, over what is there; returns the running query."""
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", log)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
