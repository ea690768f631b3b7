"""Dictionary entities: terms of a gazetteer found in texts, by label."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Places, organisations and events that are recognised by name.
GAZETTEER = {
    "GPE": "Tirunelveli|Thoothukudi|Coimbatore|Madurai|Tiruchirappalli|Salem|Erode|Vellore|Kanyakumari|Nagercoil|Chennai|Bengaluru|Hyderabad|Visakhapatnam|Thiruvananthapuram|Kochi|Kozhikode|Mysuru|Mangaluru|Puducherry|Tamil Nadu|Kerala|Karnataka|Andhra Pradesh|Telangana|Maharashtra|Uttar Pradesh|Madhya Pradesh|West Bengal|Odisha|Assam|Bihar|Gujarat|Rajasthan|Punjab".split("|"),
    "ORG": "NTRO|ISRO|DRDO|CBI|NIA|RBI|TRAI|UIDAI|NDRF|CERT-In|MeitY|NDMA|IMD|Election Commission of India|Supreme Court of India|Smart India Hackathon".split("|"),
    "EVENT": ["Smart India Hackathon 2026"],
}
# Labels of entities shown on civic views.
CIVIC = ("GPE", "LOC", "ORG")


def merged(*parts: dict[str, list[str]]) -> dict[str, list[str]]:
    """Several gazetteers as one."""
    out: dict[str, list[str]] = {}
    for p in parts:
        for label, terms in p.items():
            out[label] = [*dict.fromkeys([*out.get(label, []), *terms])]
    return out


def from_rows(df: DataFrame, most: int = 50_000) -> dict[str, list[str]]:
    """A gazetteer from ``label``, ``pattern`` rows (see ``sources.files.commented_lines``); more than ``most`` terms are refused."""
    rows = df.select("label", "pattern").dropna().distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a gazetteer of more than {most} terms has no place in a pattern")
    out: dict[str, list[str]] = {}
    for r in sorted(rows):
        out.setdefault(r.label, []).append(r.pattern)
    return out


def entities(c: Column, terms: dict[str, list[str]] = GAZETTEER) -> Column:
    """``array<struct<label, text, source>>`` of the terms that stand free of word characters, in any case.

    One alternation for each label, longest term first; by label, then in order of
    the text. A null text gives null.
    """
    found = []
    for label, words in terms.items():
        alts = "|".join(re.sub(r"([^\w\s])", r"\\\1", w) for w in sorted(words, key=len, reverse=True))
        hits = F.regexp_extract_all(c, F.lit(rf"(?iu)(?<![\p{{L}}\p{{N}}_])({alts})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
        found.append(_labelled(hits, label))
    return F.concat(*found)


def _labelled(hits: Column, label: str) -> Column:
    return F.transform(hits, lambda x: F.struct(F.lit(label).alias("label"), x.alias("text"), F.lit("gazetteer").alias("source")))


def civic(found: Column) -> Column:
    """Entities of civic labels that the gazetteer grounds."""
    return F.filter(found, lambda e: e["label"].isin(*CIVIC) & (e["source"] == "gazetteer"))


def merged_entities(dictionary: Column, model: Column | None) -> Column:
    """Dictionary entities first; of a model's only those whose text the dictionary does not name."""
    if model is None:
        return dictionary
    known = F.transform(dictionary, lambda e: F.lower(e["text"]))
    return F.concat(dictionary, F.filter(model, lambda e: ~F.array_contains(known, F.lower(e["text"]))))


def sql_hits(text: str, terms: list[str]) -> str:
    """The same search for one label in a dialect without lookaround: other signs are doubled, so that neighbours keep their borders."""
    double = lambda w: re.sub(r"([^\w])", r"\1\1", w)
    alts = "|".join(double(w) for w in sorted(terms, key=len, reverse=True))
    undo = f"regexp_extract_all(regexp_replace({text}, '([^\\p{{L}}\\p{{N}}_])', '\\1\\1', 'g'), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])({alts})(?:[^\\p{{L}}\\p{{N}}_]|$)', 1)"
    return f"list_transform({undo}, lambda x: regexp_replace(x, '([^\\p{{L}}\\p{{N}}_])[^\\p{{L}}\\p{{N}}_]', '\\1', 'g'))"
