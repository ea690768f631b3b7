"""Problem 5: one consistent text for texts that look the same.

Method: code points and strings that look alike are joined by union-find into
transitive classes, the most frequent member of a class (counted over the whole
corpus) becomes its representative, and texts are rewritten greedily, longest
match first, by a multi-pattern automaton.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.latest import latest_by, latest_wide
from quillmark.session import ship_package

# Letters of other scripts that are drawn like a Latin letter.
LOOKALIKE_LETTERS = (
    "аa еe оo рp сc уy хx іi јj ѕs ԁd ԛq ԝw һh ӏl "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЈJ ЅS ԚQ ԜW ҮY "
    "οo νv αa ιi ρp υu ϲc ϳj "
    "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX "
    "օo սu հh ԼL ՍU "
    "ıi ɑa ɡg ȷj ǀl"
)
# Code points without a width of their own.
INVISIBLE = (
    "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
)
# Spaces that are drawn like the plain space.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
# Marks of punctuation that are drawn alike.
PUNCTUATION = "\u2018' \u2019' \u201b' \u02bc' \u201c\" \u201d\" \u2010- \u2011- \u2212- \u2044/ \u2215/ \u2024. \u0589: \u2236:"
# Compatibility forms that keep the look of what they stand for.
KEPT_TAGS = {"<wide>", "<narrow>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
JOINERS = "\u200c\u200d"


class UnionFind:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        p = self.parent
        p.setdefault(x, x)
        root = x
        while p[root] != root:
            root = p[root]
        while p[x] != root:
            p[x], x = root, p[x]
        return root

    def union(self, a: str, b: str) -> None:
        ra, rb = self.find(a), self.find(b)
        if ra != rb:
            self.parent[rb] = ra


def units(text: str) -> Iterator[str]:
    """Code points, and strings of one base with the combining marks after it."""
    start, n = 0, len(text)
    while start < n:
        end = start + 1
        if text[start] >= "\u0080" or end < n and text[end] >= "\u0300":
            while end < n and unicodedata.combining(text[end]):
                end += 1
        yield text[start:end]
        start = end


def edges(seen: Iterable[str]) -> Iterator[tuple[str, str]]:
    """Pairs that look alike, among ``seen`` units and what they decompose to."""
    for pair in LOOKALIKE_LETTERS.split() + PUNCTUATION.split():
        yield pair[0], pair[1:]
    for c in INVISIBLE:
        yield c, ""
    for c in SPACES:
        yield c, " "
    for u in set(seen):
        composed, apart = unicodedata.normalize("NFC", u), unicodedata.normalize("NFD", u)
        if u != composed:
            yield u, composed
        if u != apart:
            yield u, apart
        for c in u:
            d = unicodedata.decomposition(c)
            if d.startswith("<") and d.split()[0] in KEPT_TAGS:
                yield c, unicodedata.normalize("NFKC", c)


def classes(counts: dict[str, int]) -> dict[str, str]:
    """Rewrite table: every unit that is not the representative of its class.

    The representative is the most frequent member; ties go to the shorter and
    then the smaller string. The class of the empty string keeps the empty string.
    A unit with marks whose base letter has a look-alike is joined through its base.
    """
    uf = UnionFind()
    todo = {u for u in counts if u}
    for _ in range(3):  # bases of units are rewritten, which may make new units
        for a, b in edges(todo):
            uf.union(a, b)
        single: dict[str, list[str]] = {}
        for x in list(uf.parent):
            single.setdefault(uf.find(x), []).append(x)
        best = {r: _representative(m, counts) for r, m in single.items()}
        new = set()
        for u in todo:
            if len(u) > 1:
                v = "".join(best[uf.find(c)] if c in uf.parent else c for c in u)
                if v != u and v:
                    uf.union(u, v)
                    if v not in todo:
                        new.add(v)
        if not new:
            break
        todo |= new
    members: dict[str, list[str]] = {}
    for x in list(uf.parent):
        members.setdefault(uf.find(x), []).append(x)
    table = {}
    for group in members.values():
        rep = _representative(group, counts)
        table.update({x: rep for x in group if x != rep})
    return table


def _representative(group: list[str], counts: dict[str, int]) -> str:
    return "" if "" in group else min(group, key=lambda x: (-_frequency(x, counts), len(x), x))


def _frequency(x: str, counts: dict[str, int]) -> int:
    """Count of a unit; of a string of several units that of the rarest, which it can't exceed."""
    return counts.get(x) or (min((counts.get(u, 0) for u in units(x)), default=0) if len(x) > 1 else 0)


class Rewriter:
    """Greedy longest-match rewriting by an Aho-Corasick automaton.

    A joiner between two emoji, or after a virama, changes what is drawn and stays.
    A base with more than three marks, which has no count, is composed first.
    """

    def __init__(self, table: dict[str, str]) -> None:
        import ahocorasick

        self.table = table
        self.plain = not any(k.isascii() for k in table)
        self.automaton = ahocorasick.Automaton()
        for k in table:
            self.automaton.add_word(k, k)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> str:
        if self.plain and text.isascii():
            return text
        if _ORNATE.search(text):
            text = _ORNATE.sub(lambda m: unicodedata.normalize("NFC", m.group()), text)
        out, at = [], 0
        for end, key in self.automaton.iter_long(text):
            start = end + 1 - len(key)
            if key in JOINERS and _joins(text, start):
                continue
            out.append(text[at:start])
            out.append(self.table[key])
            at = end + 1
        if not at:
            return text
        out.append(text[at:])
        return "".join(out)


#: A base with more marks than are counted as one unit; composed before anything is looked up.
_ORNATE = regex.compile(r"\P{M}\p{M}{4,}")


def _joins(text: str, i: int) -> bool:
    before, after = text[i - 1 : i], text[i + 1 : i + 2]
    if before and unicodedata.combining(before) == 9:
        return True
    pictures = ("So", "Sk", "Mn")
    return bool(before and after) and unicodedata.category(before) in pictures and unicodedata.category(after) == "So" and ord(before) > 0x2000


#: Distinct units up to which the rewrite table is made.
MOST_UNITS = 2_000_000


def unit_counts(df: DataFrame, column: str) -> dict[str, int]:
    """Counts of every unit over the whole corpus.

    The table that reaches the driver has one row for each distinct unit of up to
    three marks; the rewriter composes longer ones without a count. More than
    ``MOST_UNITS`` of them are refused, none is left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t is None:
                    continue
                if t.isascii():
                    total.update(t)
                else:
                    total.update(units(t))
        yield pa.RecordBatch.from_pydict({"u": list(total), "n": list(total.values())}, schema=pa.schema([("u", pa.string()), ("n", pa.int64())]))

    ship_package(df.sparkSession)
    per_task = df.select(column).mapInArrow(count, "u string, n bigint")
    rows = per_task.filter(F.length("u") <= 4).groupBy("u").agg(F.sum("n").alias("n")).limit(MOST_UNITS + 1).toArrow()
    if rows.num_rows > MOST_UNITS:
        raise ValueError(f"more than {MOST_UNITS} kinds of letters with marks")
    return dict(zip(rows.column("u").to_pylist(), rows.column("n").to_pylist()))


def rewrite_table(df: DataFrame, column: str) -> dict[str, str]:
    """The rewrite table of a corpus: look-alike classes with frequent representatives."""
    return classes(unit_counts(df, column))


def digest(text: str) -> bytes:
    """128 bits that stand for a text."""
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def consistent_text(df: DataFrame, key: str, column: str, time: str | None = None) -> DataFrame:
    """Rewrite ``column`` to its consistent form; returns key, original, ``consistent_text``.

    A null text gives null, an empty text stays empty. Where ``time`` is given the
    latest row of a key counts. Other columns of the input are not read, so names
    may clash freely.
    """
    table = rewrite_table(df, column)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rewriter(table)
        for b in batches:
            done = [None if t is None else r(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.string())], names=[key, column, "consistent_text"])

    base = df if time is None else latest_wide(df.select(key, column, time), [key], time, [F.xxhash64(column)])
    return base.select(F.col(key).cast("string").alias(key), column).mapInArrow(rewrite, f"`{key}` string, `{column}` string, consistent_text string")


def form_digests(df: DataFrame, key: str, column: str, time: str) -> DataFrame:
    """For the latest row of each key: digests of the text (``raw``) and of its consistent form (``form``).

    Null texts are left out. Texts are digested before the shuffle, so only 32
    bytes of a text travel.
    """
    table = rewrite_table(df, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = Rewriter(table)
        for b in batches:
            raw, form = [], []
            for t in b.column(1).to_pylist():
                if t is None:
                    raw.append(None)
                    form.append(None)
                    continue
                d = digest(t)
                u = r(t)
                raw.append(d)
                form.append(d if u is t else digest(u))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(raw, pa.binary()), pa.array(form, pa.binary())], names=["id", "at", "raw", "form"])

    at = dict(df.dtypes)[time]
    cols = df.select(F.col(key).cast("string").alias("id"), F.col(column), F.col(time).alias("at"))
    rows = cols.mapInArrow(run, f"id string, at {at}, raw binary, form binary")
    return latest_by(rows, ["id"], "at", [F.col("raw")]).filter("raw is not null").drop("at")


#: Members of a class that one task joins with all others of it.
AT_ONCE = 2_000


def same_look_pairs(digests: DataFrame) -> DataFrame:
    """Pairs of posts with equal form and different characters.

    Only classes that hold two or more different texts are joined. The pairs are
    made between the different texts of a class, never inside one text, so a
    group of exact copies of any size gives none among itself. A class of more than
    ``AT_ONCE`` members is split by a salt on one side, as often as its size asks
    for; ``look_groups`` gives the classes without any pair.
    """
    texts = digests.groupBy("form").agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"), F.count("*").alias("n")).filter("lo <> hi")
    members = digests.join(texts.select("form", F.ceil(F.col("n") / AT_ONCE).cast("int").alias("salts")), "form")
    left = members.select("form", F.col("raw").alias("raw_a"), F.col("id").alias("post_id_a"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = members.select("form", F.col("raw").alias("raw_b"), F.col("id").alias("post_id_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    return left.join(right, ["form", "salt"]).filter("raw_a <> raw_b and post_id_a < post_id_b").select("post_id_a", "post_id_b")


def look_groups(digests: DataFrame) -> DataFrame:
    """One row for each post: its class (the smallest post of equal look) and the class's size and number of spellings."""
    per_text = digests.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    per_form = per_text.groupBy("form").agg(F.sum("n").alias("members"), F.count("*").alias("spellings"), F.min("first").alias("class_id"))
    return digests.join(per_form, "form").select(F.col("id").alias("post_id"), "class_id", "members", "spellings")
