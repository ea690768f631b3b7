"""Labels, escalation rules and merges around a scorer; column expressions only.

A scorer supplies columns; a null score means that it was unavailable, and the
rules below then say so instead of guessing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmark.functions import text as T

# Words of the small built-in scorer.
POSITIVE_WORDS = "helping useful better good finally opened clear".split()
NEGATIVE_WORDS = "flooded flooding severe closed frustrating delayed waterlogging".split()
# Event terms of the small built-in scorer with their weights.
EVENT_WEIGHTS = {"flood": 0.9, "flooding": 0.9, "waterlogging": 0.85, "closed": 0.65, "delayed": 0.55, "help desk": -0.15, "deployed": -0.2}
# Topics told by a substring, first match first.
TOPIC_WORDS = {"Flooding and drainage": "flood|waterlog|rain|drainage", "Transport response": "bus|traffic|route|transport", "Public response": "official|administration|ndrf|help desk"}
# What an answer may hold.
LABELS = ("positive", "negative", "neutral")
EMOTIONS = ("anxiety", "excitement", "sarcasm", "anger", "sadness", "hope")
# The language that a script implies.
SCRIPTS = {"Devanagari": "hi", "Tamil": "ta", "Telugu": "te", "Bengali": "bn", "Gujarati": "gu", "Gurmukhi": "pa", "Kannada": "kn", "Malayalam": "ml", "Oriya": "or", "Sinhala": "si", "Arabic": "ar", "Hebrew": "he", "Cyrillic": "ru", "Greek": "el", "Thai": "th", "Hiragana": "ja", "Katakana": "ja", "Hangul": "ko", "Han": "zh"}


@dataclass(frozen=True)
class Rules:
    """Thresholds of the escalation rules."""

    weak: float = 0.45
    mixed: float = 0.30
    least_language: float = 0.70
    least_model: float = 0.60
    least_tokens: int = 2
    questions: bool = True
    no_match: bool = True


def label_of(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def signed_score(positive: Column, negative: Column) -> Column:
    """P(positive) - P(negative), within [-1, 1]."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), positive - negative))


def answer_confidence(score: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.6 + 0.4 * F.abs(score)), 4)


def lexicon_scores(c: Column) -> dict[str, Column]:
    """Shares of positive, negative and other words and their compound, from the built-in word lists."""
    w = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    p, n = (F.size(F.array_intersect(w, F.array(*map(F.lit, words)))) for words in (POSITIVE_WORDS, NEGATIVE_WORDS))
    share = lambda x: F.coalesce(F.try_divide(x.cast("double"), F.size(w).cast("double")), F.lit(0.0))
    return {"compound": (p - n) / F.greatest(p + n, F.lit(1)), "pos": share(p), "neg": share(n), "neu": 1.0 - share(p + n)}


def heuristic_label(score: Column) -> Column:
    return F.when(score > 0.15, "positive").when(score < -0.15, "negative").otherwise("neutral")


def heuristic_event(c: Column) -> tuple[Column, Column]:
    """Label and severity: the largest weight of a term in the text, 0 without one."""
    low = F.lower(c)
    s = F.coalesce(F.array_max(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(w)) for t, w in EVENT_WEIGHTS.items()]))), F.lit(0.0))
    return F.when(s >= 0.5, "negative").otherwise("neutral"), s


def keyword_topic(c: Column) -> Column:
    low, out = F.lower(c), None
    for name, words in TOPIC_WORDS.items():
        out = F.when(low.rlike(words), name) if out is None else out.when(low.rlike(words), name)
    return out.otherwise("Other civic discussion")


def is_english(lang: Column, mixed: Column) -> Column:
    return (F.coalesce(lang, F.lit("und")) == "en") & ~F.coalesce(mixed, F.lit(False))


def _reasons(found: dict[str, Column]) -> Column:
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in found.items()]))))


def first_pass_lexicon(c: Column, scores: dict[str, Column], lang: Column, sure: Column, mixed: Column, risk: Column, rules: Rules = Rules()) -> dict[str, Column]:
    """Label, score, confidence, source and escalation reasons by a lexicon scorer.

    Texts in English get a label; the reasons say where it should be checked. Too
    short texts are not worth a check, and texts of links and emoji alone are
    skipped.
    """
    empty = F.coalesce(T.empty_after_clean(c), F.lit(True)) | (F.trim(c) == "")
    english = is_english(lang, mixed)
    nothing = (scores["neu"] >= 1.0) & (scores["pos"] == 0) & (scores["neg"] == 0)
    found = {
        "no_lexicon_match": english & nothing & F.lit(rules.no_match),
        "weak_signal": english & ~nothing & (F.abs(scores["compound"]) < rules.weak),
        "mixed_polarity": english & (scores["pos"] > rules.mixed) & (scores["neg"] > rules.mixed),
        "non_english": ~english & ~F.coalesce(lang, F.lit("und")).isin("en", "und"),
        "low_language_conf": ~english & (F.coalesce(lang, F.lit("und")) == "und") | english & (F.coalesce(sure, F.lit(0.0)) < rules.least_language),
        "code_mixed": F.coalesce(mixed, F.lit(False)),
        "sarcasm_marker": F.size(T.sarcasm_markers(c)) > 0,
        "risk_signals": F.coalesce(risk, F.lit(False)),
        "question": F.contains(c, F.lit("?")) & F.lit(rules.questions),
    }
    short = F.size(T.words(c)) < rules.least_tokens
    none = F.array().cast("array<string>")
    reasons = F.when(empty | short, none).otherwise(_reasons(found))
    return {
        "label": F.when(empty | ~english, "unavailable").otherwise(label_of(scores["compound"])),
        "score": F.when(empty | ~english, 0.0).otherwise(scores["compound"]),
        "confidence": F.when(empty | ~english, 0.0).otherwise(F.round(F.least(F.lit(1.0), F.abs(scores["compound"])), 4)),
        "source": F.when(empty, "skipped_empty").when(english, "vader").otherwise("unavailable"),
        "reasons": reasons,
    }


def first_pass_model(c: Column, label: Column, score: Column, confidence: Column, lang: Column, sure: Column, mixed: Column, risk: Column, rules: Rules = Rules()) -> dict[str, Column]:
    """The same by a model's label and confidence; no least number of words here."""
    empty = F.coalesce(T.empty_after_clean(c), F.lit(True))
    english = is_english(lang, mixed)
    tongue = F.coalesce(lang, F.lit("und"))
    found = {
        "low_model_confidence": english & (confidence < rules.least_model),
        "non_english": ~english & ~tongue.isin("en", "und"),
        "low_language_conf": ~english & (tongue == "und") | english & (F.coalesce(sure, F.lit(0.0)) < rules.least_language),
        "code_mixed": F.coalesce(mixed, F.lit(False)),
        "risk_signals": F.coalesce(risk, F.lit(False)),
    }
    return {
        "label": F.when(empty | ~english, "unavailable").when(label.isin(*LABELS), label).otherwise("neutral"),
        "score": F.when(~empty & english, score).otherwise(0.0),
        "source": F.when(empty, "skipped_empty").when(english, "transformer").otherwise("unavailable"),
        "reasons": F.when(empty, F.array().cast("array<string>")).otherwise(_reasons(found)),
    }


def merged_answer(first: dict[str, Column], answered: Column, label: Column, score: Column) -> dict[str, Column]:
    """A second tier's answer over a first pass; without one the attempt is marked as failed."""
    asked = F.size(first["reasons"]) > 0
    failed = F.when(first["source"].isin("vader", "transformer"), F.concat(first["source"], F.lit("_llm_failed"))).otherwise("unavailable")
    use = asked & F.coalesce(answered, F.lit(False))
    return {
        "label": F.when(use, label).when(asked & (failed == "unavailable"), "unavailable").otherwise(first["label"]),
        "score": F.when(use, score).otherwise(first["score"]),
        "confidence": F.when(use, answer_confidence(score)).when(asked & (failed == "unavailable"), 0.0).otherwise(first.get("confidence", F.lit(None).cast("double"))),
        "source": F.when(use, "minimax").when(asked, failed).otherwise(first["source"]),
    }


def detected_language(c: Column, guess: Column, guess_sure: Column) -> dict[str, Column]:
    """Language by script, else by a detector's guess with a rescue for English; and whether it is mixed.

    ``guess`` and ``guess_sure`` come from any detector (null: it had none). A
    fragment under eight signs is English if it holds a word that is English only
    and no other script, else undetermined.
    """
    t = F.trim(c)
    letters = F.length(F.regexp_replace(t, r"\P{L}", ""))
    latin = F.regexp_count(t, F.lit(r"[\p{IsLatin}&&\p{L}]"))
    hits, ratio, tokens = T.english_evidence(t)
    facts = F.struct(t.alias("t"), letters.alias("letters"), latin.alias("latin"), hits.alias("hits"), ratio.alias("ratio"), tokens.alias("tokens"), T.distinctive_hits(t).alias("only"), guess.alias("guess"), F.coalesce(guess_sure, F.lit(0.0)).alias("sure"))
    # Bound once, so that no text is searched twice; the scripts are only counted where there are letters that are not Latin.
    told = F.transform(F.array(facts), lambda x: F.struct(x.alias("x"), F.when(x["letters"] > x["latin"], F.array(*[F.regexp_count(x["t"], F.lit(f"[\\p{{Is{s}}}&&\\p{{L}}]")) for s in SCRIPTS])).otherwise(F.array_repeat(F.lit(0), len(SCRIPTS))).alias("n")))
    out = F.transform(told, lambda y: _told(y["x"], y["n"]))[0]
    return {k: out[k] for k in ("primary_lang", "lang_confidence", "is_code_mixed")}


def _told(x: Column, n: Column) -> Column:
    t, letters, latin, guess, sure, only = (x[k] for k in ("t", "letters", "latin", "guess", "sure", "only"))
    most = F.array_max(n)
    of_script = F.element_at(F.array(*map(F.lit, SCRIPTS.values())), F.array_position(n, most).cast("int"))
    share = F.try_divide(most.cast("double"), letters.cast("double"))
    fragment = F.length(t) < 8
    by_script = ~fragment & (share >= 0.5)
    none = guess.isNull() | (sure <= 0)
    rescued = ((guess == "en") & ((x["hits"] >= 2) & (x["ratio"] >= 0.18) | (x["hits"] >= 1) & (x["tokens"] <= 8)) | (only >= 2)) & (most == 0)
    lang = (
        F.when(letters == 0, "und").when(fragment, F.when((only >= 1) & (latin > 0) & (most == 0), "en").otherwise("und"))
        .when(by_script, of_script).when(none, "und").when(rescued, "en").otherwise(guess)
    )
    small = F.when((only >= 1) & (latin > 0) & (most == 0), 0.6).otherwise(0.0)
    confidence = (
        F.when(letters == 0, 0.0).when(fragment, small)
        .when(by_script, F.round(F.least(F.lit(0.99), 0.6 + 0.4 * share), 4)).when(none, 0.0).when(rescued, F.greatest(sure, F.lit(0.8))).otherwise(sure)
    )
    mixed = (
        F.when((letters == 0) | fragment, False).when(by_script, (share < 0.9) & (latin > 2)).when(none | rescued, False)
        .otherwise((guess != "en") & (sure < 0.7) & (latin > 0) | (latin > 2) & (most > 0))
    )
    return F.struct(lang.alias("primary_lang"), confidence.alias("lang_confidence"), F.coalesce(mixed, F.lit(False)).alias("is_code_mixed"))
