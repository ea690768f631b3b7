"""Text operators that need offsets or lexicons; Arrow-batched."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# What is claimed, in order of claim.
KINDS = {
    "url": re.compile(r"https?://\S+|www\.\S+", re.I),
    "mention": re.compile(r"@[A-Za-z0-9_]{2,30}\b"),
    "hashtag": re.compile(r"#[A-Za-z0-9_]+"),
    "number": re.compile(r"\b\d[\d,.]*\b"),
}
# What counts as drawn out, as a word border inside a tag, as repeated marks, as an emoji.
EMOJI = re.compile("(?:[\U0001f1e6-\U0001f1ff]{2}|[\U0001f300-\U0001faff\u2600-\u27bf\u2b50\u2b55\u231a\u231b](?:\ufe0f|[\U0001f3fb-\U0001f3ff])?(?:\u200d[\U0001f300-\U0001faff\u2600-\u27bf](?:\ufe0f|[\U0001f3fb-\U0001f3ff])?)*)")
REPEATED = re.compile(r"([!?.])\1+")
_RUN = re.compile(r"([A-Za-z])\1{2,}")
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|_+")
_MARKS = re.compile(r"([!?])\1+")


def claimed(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) in code points; what one kind has claimed is not given to a later one."""
    taken = bytearray(len(text))
    out = []
    for kind, pattern in KINDS.items():
        for m in pattern.finditer(text):
            a, b = m.span()
            if not any(taken[a:b]):
                taken[a:b] = b"\1" * (b - a)
                out.append((kind, a, b))
    return sorted(out, key=lambda s: s[1])


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """Claimed spans, and beside them emoji and repeated marks, which claim nothing; in order."""
    more = [("emoji", *m.span()) for m in EMOJI.finditer(text)] + [("repeated", *m.span()) for m in REPEATED.finditer(text)]
    return sorted(claimed(text) + more, key=lambda s: (s[1], s[2], s[0]))


def segmented(word: str, cost: dict[str, float]) -> list[str]:
    """A word without borders cut into the words whose summed ``cost`` is least; whole if that is unknown.

    ``cost`` is the negative log-probability of known words; an unknown piece costs
    ten times its letters above the dearest known word.
    """
    if not cost:
        return [word]
    dear = max(cost.values())
    longest = max(map(len, cost))
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        best.append(min((best[i][0] + cost.get(word[i:end], dear + 10.0 * (end - i)), i) for i in range(max(0, end - max(longest, 1)), end)))
    out, end = [], len(word)
    while end:
        start = best[end][1]
        out.append(word[start:end])
        end = start
    out.reverse()
    return out if all(w in cost for w in out) else [word]


def word_costs(counts: dict[str, int]) -> dict[str, float]:
    """Costs of words by their counts."""
    total = sum(counts.values()) or 1
    return {w: math.log(total / n) for w, n in counts.items()}


def hashtag_words(tag: str, cost: dict[str, float] | None = None) -> list[str]:
    """Words of a tag in camel case or with underscores, lower case; a tag without borders is cut by word costs, if there are any."""
    words = [w.lower() for w in _HUMP.split(tag.lstrip("#")) if w]
    if len(words) == 1 and cost and len(words[0]) > 3 and not words[0].isdigit():
        return segmented(words[0], cost)
    return words


def shortened(text: str, known: set[str]) -> str:
    """Drawn-out letters as two, or as one where only that makes a known word."""

    def word(m: re.Match) -> str:
        w = m.group()
        two, one = _RUN.sub(r"\1\1", w), _RUN.sub(r"\1", w)
        return one if one.lower() in known and two.lower() not in known else two

    return re.sub(r"[^\W\d_]*([A-Za-z])\1{2,}[^\W\d_]*", word, text)


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Replacements by offsets of the original, made from the right; of overlapping ones the right one stays."""
    limit = len(text)
    for a, b, new in sorted(edits, key=lambda e: (-e[0], e[1])):
        if b <= limit:
            text = text[:a] + new + text[b:]
            limit = a
    return text


def analysis_text(text: str, known: set[str]) -> str:
    """Links and mentions dropped, tags as words, drawn-out letters shortened, repeated marks set apart."""
    edits = []
    for kind, a, b in claimed(text):
        if kind in ("url", "mention"):
            edits.append((a, b, ""))
        elif kind == "hashtag":
            edits.append((a, b, " ".join(hashtag_words(text[a:b]))))
    t = shortened(edited(text, edits), known)
    t = _MARKS.sub(lambda m: f" {m.group()}", t)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def nlp_text(text: str, known: set[str]) -> str:
    """The text for a parser: links dropped, mentions kept as words, tags as words, drawn-out letters shortened, repeated marks once."""
    edits = []
    for kind, a, b in claimed(text):
        if kind == "url":
            edits.append((a, b, ""))
        elif kind == "mention":
            edits.append((a, a + 1, ""))
        elif kind == "hashtag":
            edits.append((a, b, " ".join(hashtag_words(text[a:b]))))
    t = _MARKS.sub(r"\1", shortened(edited(text, edits), known))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", t)).strip()


def first_json(text: str) -> object | None:
    """The first balanced JSON value in a text, fences and prose around it ignored."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"[\[{]", text):
        try:
            return decoder.raw_decode(text, m.start())[0]
        except json.JSONDecodeError:
            continue
    return None


def with_spans(df: DataFrame, key: str, text: str, known: set[str] = frozenset(), cost: dict[str, float] | None = None) -> DataFrame:
    """``key``, ``spans`` array<struct<kind, start, end, text>>, ``tag_words``, ``analysis_text``, ``nlp_text`` of each text; null stays null."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())])
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [None if t is None else spans_of(t) for t in texts]
            spans = [None if f is None else [{"kind": k, "start": x, "end": y, "text": t[x:y]} for k, x, y in f] for t, f in zip(texts, found)]
            tags = [None if f is None else [w for k, x, y in f if k == "hashtag" for w in hashtag_words(t[x:y], cost)] for t, f in zip(texts, found)]
            clean, parsed = ([None if t is None else make(t, known) for t in texts] for make in (analysis_text, nlp_text))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(span)), pa.array(tags, pa.list_(pa.string())), pa.array(clean, pa.string()), pa.array(parsed, pa.string())], names=[key, "spans", "tag_words", "analysis_text", "nlp_text"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, spans array<struct<kind: string, start: int, end: int, text: string>>, tag_words array<string>, analysis_text string, nlp_text string")
