"""Problem 8: passages of held-out items inside a corpus.

Method: Wu-Manber multi-pattern search over words. Every run of ``window``
consecutive words of an item is a pattern; a table keyed by blocks of two words
says how far the search may jump, buckets keyed by the last block select the
patterns, and a direct comparison confirms an occurrence.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillmark.session import ship_package

PLAIN = re.compile(r"[a-z0-9]+")
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")
ITEMS_AT_ONCE = 20_000


def words(text: str) -> list[str]:
    """Words without letter case, punctuation and white space: runs of letters, their marks and digits, accents composed."""
    low = text.lower()
    return PLAIN.findall(low) if low.isascii() else WORD.findall(unicodedata.normalize("NFC", low))


class WuManber:
    """Search for all runs of ``window`` words of many items at once."""

    def __init__(self, items: Iterable[tuple[int, str]], window: int) -> None:
        self.window = window
        self.furthest = window - 1  # blocks hold two words
        self.shift: dict[tuple[str, str], int] = {}
        self.bucket: dict[tuple[str, str], dict[tuple[str, ...], list[int]]] = {}
        for item, text in items:
            w = words(text)
            for i in range(len(w) - window + 1):
                pattern = tuple(w[i : i + window])
                for j in range(1, window):
                    block = (pattern[j - 1], pattern[j])
                    self.shift[block] = min(self.shift.get(block, self.furthest), window - 1 - j)
                own = self.bucket.setdefault(pattern[-2:], {}).setdefault(pattern, [])
                if not own or own[-1] != item:
                    own.append(item)

    def search(self, w: list[str]) -> dict[int, int]:
        """Items found, each with the number of word positions at which one of its runs ends."""
        found: dict[int, int] = {}
        shift, bucket, m, far = self.shift, self.bucket, self.window, self.furthest
        i, n = m - 1, len(w)
        while i < n:
            block = (w[i - 1], w[i])
            step = shift.get(block, far)
            if step:
                i += step
                continue
            hits = bucket[block].get(tuple(w[i - m + 1 : i + 1]))
            if hits:
                for item in hits:
                    found[item] = found.get(item, 0) + 1
            i += 1
        return found


#: The search table a Python worker made last, so that its next task need not make it again.
_LAST: list[tuple[str, WuManber]] = []


def _table(name: str, items: list[tuple[int, str]], window: int) -> WuManber:
    if not _LAST or _LAST[0][0] != name:
        _LAST[:] = [(name, WuManber(items, window))]
    return _LAST[0][1]


def _blocks(items: DataFrame, key: str, column: str) -> Iterator[list[Row]]:
    """Items in blocks of bounded size, so a search table always fits a task."""
    block: list[Row] = []
    for row in items.select(key, column).dropna().toLocalIterator():
        block.append(row)
        if len(block) == ITEMS_AT_ONCE:
            yield block
            block = []
    if block:
        yield block


def leaks(corpus: DataFrame, items: DataFrame, *, key: str = "doc_id", column: str = "text", item_key: str = "item_id", item_column: str = "text", window: int = 12) -> DataFrame:
    """Documents with the items they leak: ``key``, ``item_key`` and ``matched_words``.

    A document leaks an item if it holds ``window`` consecutive words of it.
    ``matched_words`` is the number of document positions at which such a run
    ends, plus ``window`` - 1. The whole corpus is scanned once for each block of
    ``ITEMS_AT_ONCE`` items, without a shuffle. Null and shorter texts leak
    nothing; a repeated item is reported under each of its keys; extra columns
    are not read. Without items the result is empty.
    """
    spark = corpus.sparkSession
    ship_package(spark)
    kind, item_kind = dict(corpus.dtypes)[key], dict(items.dtypes)[item_key]
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, matched_words bigint"

    def scan(block: list[tuple[int, str]]) -> DataFrame:
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex  # ITEMS_AT_ONCE items at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _table(name, shared.value, window)
            for b in batches:
                rows, hit, n = [], [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    if t:
                        for item, ends in table.search(words(t)).items():
                            rows.append(i)
                            hit.append(item)
                            n.append(ends + window - 1)
                if rows:
                    hits = pa.array(hit, schema_type)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), hits, pa.array(n, pa.int64())], names=[key, item_key, "matched_words"])

        return corpus.select(key, column).mapInArrow(run, schema)

    from pyspark.sql.pandas.types import to_arrow_type

    schema_type = to_arrow_type(items.schema[item_key].dataType)
    parts = [scan([(r[0], r[1]) for r in block]) for block in _blocks(items, item_key, item_column)]
    if not parts:
        return corpus.select(key).limit(0).withColumn(item_key, F.lit(None).cast(item_kind)).withColumn("matched_words", F.lit(None).cast("long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def leaked_items(found: DataFrame, key: str = "doc_id", item_key: str = "item_id") -> DataFrame:
    """For each leaked item the number of documents and the longest match."""
    return found.groupBy(item_key).agg(F.countDistinct(key).alias("documents"), F.max("matched_words").alias("longest_words"))
