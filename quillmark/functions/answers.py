"""Validation of answers that come as text: salvage of broken JSON, allowed values, evidence."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.decisions import EMOTIONS, LABELS
from quillmark.functions.math import half_up

# Ids of segments, bands and states that an answer may name.
SEGMENTS = ("student", "working", "parent_family", "local_resident", "fan_viewer", "business")
AGES = ("13-17", "18-24", "25-34", "35-44", "45+")
GENDERS = ("female", "male")
STATES = "Andhra Pradesh|Arunachal Pradesh|Assam|Bihar|Chhattisgarh|Goa|Gujarat|Haryana|Himachal Pradesh|Jharkhand|Karnataka|Kerala|Madhya Pradesh|Maharashtra|Manipur|Meghalaya|Mizoram|Nagaland|Odisha|Punjab|Rajasthan|Sikkim|Tamil Nadu|Telangana|Tripura|Uttar Pradesh|Uttarakhand|West Bengal|Andaman and Nicobar Islands|Chandigarh|Dadra and Nagar Haveli and Daman and Diu|Delhi|Jammu and Kashmir|Ladakh|Lakshadweep|Puducherry".split("|")
# Words by which people speak of themselves.
FIRST_PERSON = "i|i'm|im|i am|my|me|we|we're|our|us|as an?|naan|naanum|en|enga|engal|main|mera|meri|hum|hamara"
FIRST_PERSON_INDIC = r"நான்|என்(?:\s|$)|என்னோட|எங்க(?:\s|$)|எங்கள்|मैं|मेरा|मेरी|हम"
_BAREWORD = re.compile(r'("(?:label|language)"\s*:\s*)([A-Za-z_][A-Za-z0-9_-]*)\s*(?=[,}])')
_FENCE = re.compile(r"^```(?:json)?\s*|\s*```$", re.M)


def unfenced(c: Column) -> Column:
    """The text without code fences."""
    return F.trim(F.regexp_replace(c, r"```(?:json)?", ""))


def braces(c: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty without both."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def objects(text: str | None) -> list[dict]:
    """The objects of an answer: a JSON array or object, also amid prose; else every object that came whole.

    Barewords after ``label`` and ``language`` are read as strings. What does not
    parse is left out, nothing is made up.
    """
    if not text:
        return []
    bare = _FENCE.sub("", text.strip()).strip()
    for part in (bare, *([m.group()] if (m := re.search(r"\[.*\]", bare, re.S)) else [])):
        try:
            got = json.loads(part)
        except json.JSONDecodeError:
            continue
        got = [got] if isinstance(got, dict) else got
        return [x for x in got if isinstance(x, dict)] if isinstance(got, list) else []
    repaired, out, at = _BAREWORD.sub(r'\1"\2"', bare), [], 0
    decoder = json.JSONDecoder()
    while (at := repaired.find("{", at)) >= 0:
        try:
            item, at = decoder.raw_decode(repaired, at)
            out.append(item)
        except json.JSONDecodeError:
            at = _past(repaired, at)
    return out


def _past(text: str, start: int) -> int:
    """Where the block that opens at ``start`` ends, strings and escapes respected; the next sign if it never does."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        c = text[i]
        if quoted:
            i += c == "\\"
            quoted = c != '"'
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return start + 1


ITEM = "id string, label string, score double, emotions array<string>, language string, rationale string, event_polarity string, event_severity double"


def items(df: DataFrame, key: str, reply: str) -> DataFrame:
    """Every object of every reply as a row: ``key`` and the fields of ``ITEM`` as they were said, other fields ignored."""
    kind = dict(df.dtypes)[key]
    text = lambda o, k: None if o.get(k) is None else str(o[k])

    def number(o: dict, k: str) -> float:
        try:
            return float(o.get(k) or 0)
        except (TypeError, ValueError):
            return 0.0

    def listed(x: object) -> list[str]:
        return [x] if isinstance(x, str) else [e for e in x if isinstance(e, str)] if isinstance(x, list) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, found = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for o in objects(t):
                    own.append(i)
                    found.append(o)
            cols = [b.column(0).take(pa.array(own, pa.int64())), *(pa.array([text(o, k) for o in found], pa.string()) for k in ("id", "label")), pa.array([number(o, "score") for o in found], pa.float64()), pa.array([listed(o.get("emotions")) for o in found], pa.list_(pa.string()))]
            cols += [*(pa.array([text(o, k) for o in found], pa.string()) for k in ("language", "rationale", "event_polarity")), pa.array([number(o, "event_severity") for o in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, *(x.split()[0] for x in ITEM.split(", "))])

    return df.select(key, reply).mapInArrow(run, f"`{key}` {kind}, {ITEM}")


def cleaned(df: DataFrame) -> DataFrame:
    """Items with an allowed label; scores within bounds, allowed emotions only, texts cut."""
    low = lambda c: F.lower(F.trim(F.col(c)))
    unit = lambda c, least: F.greatest(F.lit(least), F.least(F.lit(1.0), F.coalesce(F.col(c), F.lit(0.0))))
    return df.withColumns({
        "label": low("label"), "score": unit("score", -1.0), "event_severity": unit("event_severity", 0.0), "emotions": F.array_intersect(F.transform("emotions", lambda e: F.lower(F.trim(e))), F.array(*map(F.lit, EMOTIONS))),
        "language": F.nullif(low("language"), F.lit("")), "rationale": F.left(F.trim("rationale"), F.lit(200)), "event_polarity": F.when(low("event_polarity").isin("negative", "positive", "none"), low("event_polarity")),
    }).filter(F.col("label").isin(*LABELS))


def valid_segment(text: Column, segment: Column, evidence: Column, confidence: Column) -> Column:
    """``struct<id, evidence, confidence>``; ``unstated`` unless a short first-person phrase of the text itself says so with enough confidence."""
    e = F.trim(evidence)
    first = e.rlike(rf"(?iu)(?<!\p{{L}})(?:{FIRST_PERSON})(?!\p{{L}})") | e.rlike(f"(?iu){FIRST_PERSON_INDIC}")
    inside = F.contains(F.lower(text), F.lower(e)) & ((F.length(text) <= 30) | (F.length(e) <= F.length(text) * 0.7))
    ok = segment.isin(*SEGMENTS) & (F.length(e) > 0) & (F.length(e) <= 80) & inside & first & confidence.between(0.6, 1.0)
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(F.when(ok, segment).otherwise("unstated").alias("id"), F.when(ok, e).alias("evidence"), F.when(ok, half_up(confidence, 2)).alias("confidence"))


def valid_estimate(age: Column, gender: Column, region: Column, state: Column, confidence: Column) -> Column:
    """``struct<age, gender, region, state, confidence>``: allowed values only, a state only within IN, all null without enough confidence."""
    ok = F.coalesce(confidence.between(0.4, 1.0), F.lit(False))
    code = F.upper(F.trim(region))
    code = F.when(code.rlike("^[A-Z]{2}$"), code)
    names = F.create_map(*[F.lit(x) for s in STATES for x in (s.lower(), s)])
    within = F.when(code == "IN", F.try_element_at(names, F.lower(F.trim(state))))
    return F.struct(*[F.when(ok, c).alias(k) for k, c in {"age": F.when(age.isin(*AGES), age), "gender": F.when(gender.isin(*GENDERS), gender), "region": code, "state": within, "confidence": half_up(confidence, 2)}.items()])


def valid_stance(text: Column, emotions: Column, target: Column, stance: Column) -> Column:
    """``struct<emotions, target, stance>``: allowed emotions once each; a stance only towards a target quoted from the text."""
    t = F.trim(target)
    quoted = F.when((F.length(t) > 0) & F.contains(F.lower(text), F.lower(t)), F.left(t, F.lit(150)))
    kept = F.array_distinct(F.filter(emotions, lambda e: e.isin(*EMOTIONS)))
    return F.struct(kept.alias("emotions"), quoted.alias("target"), F.when(quoted.isNotNull() & stance.isin("supportive", "opposed"), stance).otherwise("unclear").alias("stance"))
