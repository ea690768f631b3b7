"""Problem 4: records that are equal but for their formatting.

Method: progressive partition refinement. All records are first grouped by cheap
invariants (stripped length and letter histogram); only inside classes with
several members the costlier key is made, in which look-alikes are rewritten,
case, white space and punctuation go, and ``name: value`` fields are ordered.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.lookalike import Rewriter, rewrite_table
from quillmark.operators.latest import latest_by, sieve, sifted
from quillmark.session import materialise, ship_package

FIELD = re.compile(r"^\s*(?:[^\W\d_][^\W_]*[ \t]*){1,4}:(?!//)\s*(?=\S)")
SEPARATOR = re.compile(r"[;/|,\n\r]+")
_DROP = bytes(i for i in range(128) if not chr(i).isalnum())


def stripped(text: str) -> str:
    """Case-folded letters, marks and digits of a text, in order."""
    if text.isascii():
        return text.encode().lower().translate(None, _DROP).decode()
    return "".join([c for c in unicodedata.normalize("NFC", text.casefold()) if c.isalnum() or _content(c)])


def _content(c: str) -> bool:
    """Vowel signs and pictures; they are neither punctuation nor white space."""
    kind = unicodedata.category(c)
    return kind == "So" or kind == "Sk" and c > "\uffff" or kind[0] == "M" and not "\ufe00" <= c <= "\ufe0f"


def invariant(text: str) -> tuple[int, bytes] | None:
    """Stripped length and letter histogram; they don't depend on order. None without a letter or digit."""
    s = stripped(text)
    if not any(c.isalnum() for c in s[:64]) and not any(c.isalnum() for c in s):
        return None
    return len(s), hashlib.blake2b("".join(sorted(s)).encode("utf-8", "surrogatepass"), digest_size=8).digest()


def exact_key(text: str) -> str:
    """The text without formatting; runs of ``name: value`` fields are put in order."""
    if ":" in text:
        parts = [p for p in SEPARATOR.split(text) if p.strip()]
        fields = [bool(FIELD.match(p)) for p in parts]
        if sum(fields) >= 2:
            rest = [stripped(p) for p, f in zip(parts, fields) if not f]
            own = sorted(stripped(p) for p, f in zip(parts, fields) if f)
            return "".join(rest) + "\x1f" + "\x1f".join(own)
    return stripped(text)


def _scan(df: DataFrame, key: str, column: str, time: str) -> DataFrame:
    return df.select(F.col(key).cast("string").alias("id"), F.col(column).alias("text"), F.col(time).alias("at"), F.xxhash64(column).alias("tie"))


def format_duplicates(df: DataFrame, key: str, column: str, time: str) -> DataFrame:
    """One row for each post whose text has a letter or digit: ``post_id``, ``first_post_id``, ``copies``.

    ``first_post_id`` is the smallest post of the group, ``copies`` the size of
    the group. The latest row of a post counts; null texts and texts without
    letter or digit have no row. Groups are only counted and joined by digest, so
    a group may hold any share of all rows. Texts are read twice and never shuffled.
    """
    ship_package(df.sparkSession)
    table = rewrite_table(df, column)
    at = dict(df.dtypes)[time]

    def cheap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rewriter(table)
        for b in batches:
            size, hist = [], []
            for t in b.column(1).to_pylist():
                x = None if t is None else invariant(r(t))
                size.append(x and x[0])
                hist.append(x and x[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(size, pa.int32()), pa.array(hist, pa.binary())], names=["id", "at", "tie", "size", "hist"])

    def costly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rewriter(table)
        for b in batches:
            keys = [hashlib.blake2b(exact_key(r(t)).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), pa.array(keys, pa.binary())], names=["id", "at", "tie", "exact"])

    rows = _scan(df, key, column, time)
    schema = f"id string, at {at}, tie bigint, size int, hist binary"
    # Refinement 1: cheap invariants of every row's latest state.
    latest = latest_by(rows.mapInArrow(cheap, schema), ["id"], "at", [F.col("tie")]).filter("hist is not null").drop("at", "tie")
    narrow = materialise(latest, "invariants")
    several = narrow.groupBy("size", "hist").agg(F.count("*").alias("n")).filter("n > 1").select("size", "hist")
    in_several = narrow.join(several, ["size", "hist"], "left_semi").select(F.xxhash64("id").alias("h"))
    # Refinement 2: the costly key, where the texts are read, for members of such classes and the few a sieve lets through besides.
    candidates = sifted(rows, F.xxhash64("id"), sieve(in_several), "again").filter("again and text is not null").drop("again")
    keyed = latest_by(candidates.mapInArrow(costly, f"id string, at {at}, tie bigint, exact binary"), ["id"], "at", [F.col("tie")]).join(narrow.select("id"), "id", "left_semi")
    keyed = materialise(keyed.select("id", "exact"), "exact-keys")
    groups = keyed.groupBy("exact").agg(F.count("*").alias("copies"), F.min("id").alias("first_post_id"))
    grouped = keyed.join(groups, "exact").select(F.col("id").alias("post_id"), "first_post_id", "copies")
    alone = narrow.join(keyed.select("id"), "id", "left_anti").select(F.col("id").alias("post_id"), F.col("id").alias("first_post_id"), F.lit(1).cast("long").alias("copies"))
    return grouped.unionByName(alone)


def kept_posts(members: DataFrame) -> DataFrame:
    """One kept post for each text with its number of copies."""
    return members.filter("post_id = first_post_id").select("post_id", "copies")
