"""Problem 2: the language of texts and of the segments of mixed texts.

Method: sparse multinomial logistic regression on TF-IDF character n-grams of
words, trained by follow-the-regularised-leader with elastic-net penalties on a
bounded sample of rows with a label, then calibrated by a temperature. Segments
are the best path through the word probabilities with a price for each change
of language.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.llm.lookalike import Rewriter, classes
from quillmark.llm.pii import spans
from quillmark.operators.latest import latest_by
from quillmark.session import ship_package

#: Labelled rows of each language to learn from; the only sample taken here.
SAMPLE_ROWS = 2_000
#: Languages with fewer labelled rows than this are not learned.
LEAST_ROWS = 12
LEAST_RUN = 4
SWITCH = 4.0

# ISO 639-1 code, ISO 639-2 and -3 codes, English and own names.
LANGUAGES = """
en eng english
ta tam tamil தமிழ்
hi hin hindi हिन्दी हिंदी hinglish
es spa esp spanish español castellano espanol
fr fra fre french français francais
de deu ger german deutsch
pt por portuguese português portugues
it ita italian italiano
nl nld dut dutch nederlands
id ind indonesian
ms msa may malay
sw swa swahili kiswahili
tl tgl tagalog filipino fil
bn ben bengali bangla বাংলা
te tel telugu తెలుగు
mr mar marathi मराठी
gu guj gujarati ગુજરાતી
kn kan kannada ಕನ್ನಡ
ml mal malayalam മലയാളം
pa pan punjabi ਪੰਜਾਬੀ
ur urd urdu اردو
or ori ory odia
as asm assamese
ne nep nepali नेपाली
si sin sinhala
ar ara arabic العربية
fa fas per persian farsi
tr tur turkish türkçe
ru rus russian русский
uk ukr ukrainian українська
pl pol polish polski
cs ces cze czech čeština
sk slk slo slovak
ro ron rum romanian română
hu hun hungarian magyar
el ell gre greek ελληνικά
sv swe swedish svenska
da dan danish dansk
no nor norwegian norsk
nb nob bokmål
fi fin finnish suomi
he heb hebrew עברית
zh zho chi chinese mandarin 中文
ja jpn japanese 日本語
ko kor korean 한국어
vi vie vietnamese
th tha thai ไทย
ca cat catalan català
eu eus baq basque
gl glg galician
hr hrv croatian
sr srp serbian
bg bul bulgarian
la lat latin
af afr afrikaans
"""
CODES = {name: line.split()[0] for line in LANGUAGES.strip().split("\n") for name in line.split()}


def code(label: str | None) -> str | None:
    """ISO 639-1 code of a label in any spelling, region and script aside; None if it names no language."""
    if not label:
        return None
    x = re.split(r"[\s_\-(/]", label.strip().lower(), maxsplit=1)[0]
    return CODES.get(x) or CODES.get(label.strip().lower())


_SKIP = re.compile(r"https?://\S+|www\.\S+|\S*@\S+|[#@][\w.]+|\[[A-Z]+\]")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯऀ-ःऺ-ॏॢॣஂா-்ௗ'’‌‍])*")
_ANY_DIGIT = re.compile(r"\d")
_MANY = re.compile(r"([^\W\d_])\1{2,}")
_REWRITER: list[Rewriter] = []


def _folded(word: str) -> str:
    """A word as the model knows it: look-alikes equal, lower case, drawn-out letters once."""
    if not word.isascii():
        if not _REWRITER:
            _REWRITER.append(Rewriter(classes({chr(i): 1000 for i in range(32, 127)} | {chr(i): 1 for i in range(0xFF01, 0xFF5F)})))
        word = _REWRITER[0](word)
    return _MANY.sub(r"\1", word.lower().strip("'’"))


_FOLDED: dict[str, str] = {}


def words(text: str) -> list[tuple[int, int, str]]:
    """Words that tell a language: (start, end, folded word). Links, tags, personal data and numbers are left out."""
    banned = [m.span() for m in _SKIP.finditer(text)] if "@" in text or "#" in text or "/" in text or "[" in text or "www." in text else []
    banned += [(a, b) for a, b, _, _ in spans(text)]
    digits = _ANY_DIGIT.search(text) is not None
    out = []
    for m in _WORD.finditer(text):
        a, b = m.span()
        if banned and any(x <= a < y for x, y in banned):
            continue
        if digits and (a and text[a - 1].isdigit() or text[b : b + 1].isdigit()):
            continue
        word = m.group()
        w = _FOLDED.get(word)
        if w is None:
            w = _folded(word)
            if len(_FOLDED) < 300_000:  # a memory, not a limit: a word beyond it is folded again
                _FOLDED[word] = w
        if w:
            out.append((a, b, w))
    return out


def grams(word: str) -> list[str]:
    """Character n-grams of one to four signs of a word with its borders."""
    w = f"<{word}>"
    n = len(w)
    return [w[i : i + k] for k in (1, 2, 3, 4) for i in range(n - k + 1) if k > 1 or w[i] not in "<>"]


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, features: int, kinds: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.3, l2: float = 0.3) -> None:
        self.z = np.zeros((features + 1, kinds))
        self.n = np.zeros((features + 1, kinds))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def learn(self, rows: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(rows)
        s = x @ w
        p = np.exp(s - s.max())
        p /= p.sum()
        p[y] -= 1.0
        g = x[:, None] * p
        n = self.n[rows]
        more = n + g * g
        self.z[rows] += g - (np.sqrt(more) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = more


class LanguageModel:
    """Word n-gram weights of each language, with a temperature."""

    def __init__(self, langs: list[str], index: dict[str, int], idf: np.ndarray, weights: np.ndarray, temperature: float = 1.0) -> None:
        self.langs, self.index, self.idf, self.weights, self.temperature = langs, index, idf, weights, temperature
        self.seen: dict[str, tuple[np.ndarray, float, np.ndarray]] = {}

    def vector(self, ws: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows and L2-normalised TF-IDF values of some words, with a constant last."""
        tf = Counter(i for w in ws for g in grams(w) if (i := self.index.get(g)) is not None)
        rows = np.fromiter(tf, np.int64, len(tf))
        x = np.fromiter(tf.values(), float, len(tf)) * self.idf[rows] if len(tf) else np.zeros(0)
        norm = math.sqrt(float(x @ x)) or 1.0
        return np.append(rows, len(self.idf)), np.append(x / norm, 0.2)

    def word(self, w: str) -> tuple[np.ndarray, float, np.ndarray]:
        """Raw scores, squared norm and log-probabilities of one word."""
        got = self.seen.get(w)
        if got is None:
            rows = [i for g in grams(w) if (i := self.index.get(g)) is not None]
            x = self.idf[rows]
            raw = x @ self.weights[rows] if rows else np.zeros(len(self.langs))
            norm2 = float(x @ x)
            s = raw / (math.sqrt(norm2) or 1.0) + 0.2 * self.weights[-1]
            got = raw, norm2, s - s.max() - math.log(np.exp(s - s.max()).sum())
            if len(self.seen) < 300_000:
                self.seen[w] = got
        return got

    def together(self, ws: list[str]) -> np.ndarray:
        """Calibrated probabilities of some words taken together."""
        raw = sum((self.word(w)[0] for w in ws), np.zeros(len(self.langs)))
        norm2 = sum(self.word(w)[1] for w in ws)
        s = (raw / (math.sqrt(norm2) or 1.0) + 0.2 * self.weights[-1]) / self.temperature
        p = np.exp(s - s.max())
        return p / p.sum()

    def paths(self, scores: np.ndarray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The best language of each word of each text, with a price of ``SWITCH`` for each change.

        ``flat`` holds the words of all texts as rows of ``scores``, ``ends`` where a
        text ends. Texts whose words agree need no search; the others are searched
        together, in order of length, one step of all of them at a time.
        """
        starts = np.concatenate([[0], ends[:-1]])
        best = scores.argmax(1)[flat]
        agree = np.minimum.reduceat(best, starts) == np.maximum.reduceat(best, starts)
        size = ends - starts
        open_texts = np.flatnonzero(~agree)
        open_texts = open_texts[np.argsort(size[open_texts], kind="stable")]
        own = np.arange(len(self.langs))
        padded = np.vstack([scores, np.zeros(len(self.langs))])
        for i in range(0, len(open_texts), 256):
            group = open_texts[i : i + 256]
            n, longest = len(group), int(size[group].max())
            place = starts[group][:, None] + np.arange(longest)
            inside = np.arange(longest) < size[group][:, None]
            word = np.where(inside, flat[np.minimum(place, len(flat) - 1)], len(scores))
            back = np.empty((longest, n, len(self.langs)), np.int16)
            rows = np.arange(n)
            v = padded[word[:, 0]]
            for t in range(1, longest):
                top = v.argmax(1)
                changed = (v[rows, top] - SWITCH)[:, None]
                jump = changed > v
                back[t] = np.where(jump, top[:, None], own)
                v = np.where(jump, changed, v) + padded[word[:, t]]
            at = v.argmax(1)  # past its end a text keeps its best language
            path = np.empty((n, longest), np.int64)
            for t in range(longest - 1, 0, -1):
                path[:, t] = at
                at = back[t][rows, at]
            path[:, 0] = at
            best[place[inside]] = path[inside]
        return best

    def read_all(self, texts: list[str | None]) -> list[dict | None]:
        """Language, confidence and segments of texts; None for those without words.

        Every distinct word is scored once for all texts.
        """
        found = [words(t) if t else [] for t in texts]
        number: dict[str, int] = {}
        flat = np.array([number.setdefault(w, len(number)) for f in found for _, _, w in f], np.int64)
        if not len(flat):
            return [None] * len(texts)
        scored = [self.word(w) for w in number]
        raw, norm2 = np.stack([x[0] for x in scored]), np.array([x[1] for x in scored])
        full = [i for i, f in enumerate(found) if f]
        ends = np.cumsum([len(found[i]) for i in full])
        path = self.paths(np.stack([x[2] for x in scored]), flat, ends)
        mains, sets, segments = [], [], []  # a segment: [language, first word, end], by place in flat
        first = 0
        for end in ends.tolist():
            own = path[first:end].tolist()
            runs: list[list[int]] = []
            for i, k in enumerate(own, first):
                if runs and runs[-1][0] == k:
                    runs[-1][2] = i + 1
                else:
                    runs.append([k, i, i + 1])
            if len(runs) == 1:
                main, langs, merged = own[0], {own[0]}, runs
            else:
                count = Counter(own)
                main = max(count, key=lambda k: (count[k], -own.index(k)))
                langs = {main} | {k for k, a, b in runs if k != main and b - a >= LEAST_RUN}
                merged = []
                for k, a, b in runs:
                    k = k if k in langs else main
                    if merged and merged[-1][0] == k:
                        merged[-1][2] = b
                    else:
                        merged.append([k, a, b])
            mains.append(main)
            sets.append(langs)
            segments.append(merged)
            first = end
        every = [s for m in segments for s in m]  # they tile ``flat``
        starts = np.array([s[1] for s in every])
        length = np.sqrt(np.add.reduceat(norm2[flat], starts))
        score = np.add.reduceat(raw[flat], starts, axis=0) / np.where(length > 0, length, 1.0)[:, None]
        score = (score + 0.2 * self.weights[-1]) / self.temperature
        p = np.exp(score - score.max(1, keepdims=True))
        sure = (p[np.arange(len(every)), [s[0] for s in every]] / p.sum(1)).tolist()
        out: list[dict | None] = [None] * len(texts)
        at = first = 0
        for i, main, langs, merged, end in zip(full, mains, sets, segments, ends.tolist()):
            f = found[i]
            pieces, size, total = [], 0, 0.0
            for (k, a, b), c in zip(merged, sure[at : at + len(merged)]):
                pieces.append({"start": f[a - first][0], "end": f[b - 1 - first][1], "lang": self.langs[k], "confidence": c})
                if k == main:
                    size += b - a
                    total += (b - a) * c
            out[i] = {"lang": self.langs[main], "confidence": total / max(1, size), "mixed": len(langs) > 1, "langs": sorted(self.langs[k] for k in langs), "segments": pieces}
            at += len(merged)
            first = end
        return out

    def read(self, text: str) -> dict | None:
        """Language, confidence and segments of one text; None without words."""
        return self.read_all([text])[0]


def _fit(samples: list[tuple[list[str], int]], langs: list[str], seed: int, epochs: int = 2) -> LanguageModel:
    rng = random.Random(seed)
    df: Counter[str] = Counter()
    for ws, _ in samples:
        df.update({g for w in set(ws) for g in grams(w)})
    least = 2 if len(samples) > 500 else 1
    index = {g: i for i, g in enumerate(sorted(g for g, n in df.items() if n >= least))}
    idf = np.array([math.log((1 + len(samples)) / (1 + df[g])) + 1 for g in index])
    model = LanguageModel(langs, index, idf, np.zeros((len(index) + 1, len(langs))))
    learner = Ftrl(len(index), len(langs))
    for _ in range(epochs):
        rng.shuffle(samples)
        for ws, y in samples:
            n = rng.choice((1, 2, 4, 8, 16))
            a = rng.randrange(max(1, len(ws) - n + 1))
            learner.learn(*model.vector(ws[a : a + n]), y)
    model.weights = learner.weights(slice(None))
    return model


def train(rows: list[tuple[str, str]], seed: int = 11) -> LanguageModel:
    """Fit on (text, code) rows of which some codes are wrong.

    A first fit finds the rows whose own label is improbable; they are left out of
    the second. A tenth of the rows is kept back for the temperature.
    """
    count = Counter(c for _, c in rows)
    langs = sorted(c for c, n in count.items() if n >= min(LEAST_ROWS, max(count.values(), default=0)))
    if not langs:
        langs = ["und"]
    number = {c: i for i, c in enumerate(langs)}
    samples = [(ws, number[c]) for t, c in rows if c in number and (ws := [w for _, _, w in words(t)])]
    random.Random(seed).shuffle(samples)
    clean = samples
    for _ in range(2):
        model = _fit(list(clean), langs, seed, epochs=1)
        kept = [(ws, y) for ws, y in samples if model.together(ws)[y] >= 0.5 * model.together(ws).max()]
        # A label that its own text denies almost always is no language of this corpus.
        clean = kept or samples
    held, rest = clean[: len(clean) // 10], clean[len(clean) // 10 :]
    model = _fit(list(rest) or list(clean), langs, seed)
    if held:
        raw = []
        for ws, y in held:
            r = sum((model.word(w)[0] for w in ws), np.zeros(len(langs))) / (math.sqrt(sum(model.word(w)[1] for w in ws)) or 1.0) + 0.2 * model.weights[-1]
            raw.append((r, y))

        def loss(t: float) -> float:
            return sum(math.log(np.exp((r - r.max()) / t).sum()) - (r[y] - r.max()) / t for r, y in raw)

        model.temperature = min((0.3 * 1.15**i for i in range(24)), key=loss)
    model.seen.clear()
    used = np.abs(model.weights[:-1]).sum(1) > 0  # the penalty leaves most rows empty
    keep = [g for g, i in model.index.items() if used[i]]
    rows_kept = [model.index[g] for g in keep]
    return LanguageModel(langs, {g: i for i, g in enumerate(keep)}, model.idf[rows_kept], np.vstack([model.weights[rows_kept], model.weights[-1:]]), model.temperature)


def labelled_sample(df: DataFrame, column: str, label: str, per_language: int = SAMPLE_ROWS) -> list[tuple[str, str]]:
    """At most ``per_language`` rows of each language a label names, in order of a hash of the text."""
    names = [F.lit(x) for k, v in CODES.items() for x in (k, v)]
    first = F.element_at(F.split(F.lower(F.trim(label)), r"[\s_\-(/]"), 1)
    lang = F.try_element_at(F.create_map(*names), first)
    w = Window.partitionBy("lang").orderBy(F.xxhash64(column), column)
    rows = df.select(column, lang.alias("lang")).filter(F.col("lang").isNotNull() & (F.length(F.trim(column)) > 0))
    picked = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_language).select(column, "lang")
    return sorted((r[0], r[1]) for r in picked.collect())


def languages(df: DataFrame, key: str, column: str, time: str | None = None, label: str | None = None, model: LanguageModel | None = None) -> DataFrame:
    """Language of every text: ``key``, ``lang``, ``confidence``, ``mixed``, ``langs``, ``segments`` (, ``label_code``).

    The model is learned from ``label`` unless one is given. Null texts and texts
    without words have null in all result columns. Where ``time`` is given the
    latest row of a key counts. ``label_code`` is the ISO 639-1 code the row's own
    label names, null if it names none.
    """
    ship_package(df.sparkSession)
    if model is None:
        if label is None:
            raise ValueError("a label column or a model is needed")
        model = train(labelled_sample(df, column, label))
    kinds = dict(df.dtypes)
    at = F.lit(0).cast("long") if time is None else F.col(time)
    at_type = "bigint" if time is None else kinds[time]
    tag = F.lit(None).cast("string") if label is None else F.col(label)
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = m.read_all(b.column(1).to_pylist())
            pick = lambda c, kind: pa.array([None if o is None else o[c] for o in out], kind)  # noqa: E731, B023
            codes = pa.array([code(x) for x in b.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(4), codes, pick("lang", pa.string()), pick("confidence", pa.float64()), pick("mixed", pa.bool_()), pick("langs", pa.list_(pa.string())), pick("segments", pa.list_(span))],
                names=["k", "at", "tie", "label_code", "lang", "confidence", "mixed", "langs", "segments"],
            )

    schema = f"k {kinds[key]}, at {at_type}, tie bigint, label_code string, lang string, confidence double, mixed boolean, langs array<string>, segments array<struct<start: int, end: int, lang: string, confidence: double>>"
    rows = df.select(F.col(key).alias("k"), F.col(column).alias("t"), at.alias("at"), tag.alias("tag"), F.xxhash64(column, tag).alias("tie")).mapInArrow(run, schema)
    if time is not None:
        rows = latest_by(rows, ["k"], "at", [F.col("tie")])
    return rows.select(F.col("k").alias(key), "lang", "confidence", "mixed", "langs", "segments", "label_code")


def iso(c: Column) -> Column:
    """ISO 639-1 code of a label column, null if it names no language."""
    names = [F.lit(x) for k, v in CODES.items() for x in (k, v)]
    return F.try_element_at(F.create_map(*names), F.element_at(F.split(F.lower(F.trim(c)), r"[\s_\-(/]"), 1))


def label_faults(found: DataFrame, info: DataFrame, key: str = "post_id") -> DataFrame:
    """Wrong labels: ``key``, ``field_name``, ``lang``.

    ``lang_hint`` if the post's own label is missing or another language,
    ``primary_lang`` if the row of ``info`` names another, ``is_code_mixed`` for
    each language of the text if that row's flag does not say what the text is.
    Posts without words, and for the latter two posts without a row in ``info``,
    have none.
    """
    known = found.filter("lang is not null")
    # One row for each post; should there be several, the greatest counts, so that the result is always the same.
    own = info.groupBy(key).agg(F.max(F.struct(iso(F.col("primary_lang")).alias("said"), "is_code_mixed")).alias("own")).select(key, "own.said", "own.is_code_mixed")
    hint = known.filter("not (label_code <=> lang)").select(key, F.lit("lang_hint").alias("field_name"), "lang")
    both = known.join(own, key)
    primary = both.filter("not (said <=> lang)").select(key, F.lit("primary_lang").alias("field_name"), "lang")
    flag = F.coalesce("is_code_mixed", F.lit(False))
    mixed = both.filter(flag != F.col("mixed")).select(key, F.lit("is_code_mixed").alias("field_name"), F.explode("langs").alias("lang"))
    return hint.unionByName(primary).unionByName(mixed)
