"""Problems 8, 9, 10: corpus operators."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.llm import leakage, mixing, residue

# --- problem 8


def docs_and_items(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 40)))) for i in range(12)]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5:
            t = rng.choice(items)[1].split()
            a = rng.randrange(len(t))
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() + rng.choice(["", ",", "  "]) for x in t[a : a + rng.randint(8, 20)]]
        docs.append((d, " ".join(w)))
    return docs + [(98, None), (99, "")], items


@pytest.mark.parametrize("window", [4, 12])
def test_leaks_against_brute_force(spark, window):
    docs, items = docs_and_items(window)
    want = set()
    for d, t in docs:
        w = leakage.words(t or "")
        runs = {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
        for i, s in items:
            v = leakage.words(s)
            if any(tuple(v[k : k + window]) in runs for k in range(len(v) - window + 1)):
                want.add((d, i))
    corpus = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    found = leakage.leaks(corpus, spark.createDataFrame(items, "item_id bigint, text string"), window=window)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and want
    assert {r.item_id for r in leakage.leaked_items(found).collect()} == {i for _, i in want}


def test_leaks_in_blocks_and_empty(spark, monkeypatch):
    docs, items = docs_and_items(5)
    corpus, held = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = sorted(map(tuple, leakage.leaks(corpus, held).collect()))
    monkeypatch.setattr(leakage, "ITEMS_AT_ONCE", 5)
    assert sorted(map(tuple, leakage.leaks(corpus, held).collect())) == whole
    assert leakage.leaks(corpus, held.limit(0)).count() == 0 and leakage.leaks(corpus.limit(0), held).count() == 0


# --- problem 9


def test_too_many_targets_are_refused(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b", "x", "en"), (2, "a c", "y", "en")], "doc_id bigint, text string, source string, lang string")
    targets = spark.createDataFrame([("x", 0.5, 1), ("y", 0.5, 1)], "source string, target_share double, max_repeats int")
    monkeypatch.setattr(mixing, "MOST_TARGETS", 1, raising=False)
    with pytest.raises(ValueError):
        mixing.mix(docs, targets)


def test_mix_meets_shares(spark):
    rng = random.Random(1)
    rows = [(i, " ".join("word" for _ in range(rng.randint(1, 60))), rng.choice(["en", "EN-us", None, "ta"]), rng.choice(["a", "A", " b", "b", "c", None, "x"]), "k") for i in range(3000)] + [(-1, None, "en", "a", "k"), (-2, "", "en", "a", "k")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, content_kind string").withColumn("uses", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 3)], "source string, target_share double, max_repeats int")
    m = mixing.mix(docs, targets).cache()
    got = {r.source: r for r in mixing.reached_shares(m, targets).collect()}
    assert all(abs(got[s].reached_share - t) < 0.01 and got[s].most_uses <= got[s].max_repeats for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    assert m.count() == m.select("doc_id").distinct().count() and m.filter("doc_id < 0").count() == 0
    assert mixing.mix(docs, targets.limit(0)).count() == 0 and mixing.mix(docs.limit(0), targets).count() == 0


def test_rake_respects_caps():
    import numpy as np

    tokens = np.array([100.0, 50.0, 10.0, 40.0])
    uses = mixing.rake(tokens, [np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])], [np.array([0.5, 0.5]), np.array([0.55, 0.45])], np.array([1.0, 1.0, 4.0, 4.0]), 200.0)
    assert (uses <= [1, 1, 4, 4]).all() and abs((tokens * uses)[:2].sum() - 100) < 1e-6 and abs((tokens * uses)[2:].sum() - 100) < 1e-6


def test_token_round_trip():
    e = mixing.encoder(mixing.TOKENIZER)
    for t in ("hello world", "சாலை 12", "<|endoftext|>", " \n\t x"):
        assert e.decode(e.encode_ordinary(t)) == t


# --- problem 10

PROSE = ["The road near the market is still closed and nobody told the people who live there. We asked for a team twice."] * 40 + ["La calle sigue cerrada desde el lunes y nadie contesta el teléfono. Hay que limpiar el canal pronto."] * 20
RESIDUE = ["Hello {{name}}, your ticket is open. The road is closed.", "%(date)s wrote this.", "Dear [insert name here], thank you.", "lorem ipsum dolor sit amet consectetur adipiscing elit. " + PROSE[0], "Page not found. Try again later.", "Please enable JavaScript to continue.", "xxx xxx xxx xxx", "Posted by [object Object] today.", "ward: undefined, seen on undefined", "The meeting in <<place>> starts soon."]
REAL = ["The sign says page not found, a joke of the library, and everybody in the street laughed about it for a week.", "The circular lists [ward office] and $500 as the deposit, so 100% paid.", "The clerk said to enable scripts and the form opened after that, but the road is still closed.", "", None]


def test_residue(spark):
    texts = PROSE + RESIDUE + REAL + ["long text about the road. " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumn("residue", F.lit(9))
    bad = {r.doc_id for r in residue.residue(df).filter("residue").collect()}
    assert bad == set(range(len(PROSE), len(PROSE) + len(RESIDUE)))
    assert residue.residue(df.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["सड़क पर आज भी पानी नहीं है और लोग बहुत परेशान दिखते हैं", "நேற்று மாலை நாங்கள் ஊருக்கு சென்ற போது அங்கே தண்ணீர் வரவில்லை என்று மக்கள் சொன்னார்கள் பாவம்", "caf\u00e9 un deux trois quatre cinq six sept huit neuf dix onze douze"])
def test_words_of_every_script(spark, text):
    import unicodedata

    w = leakage.words(text)
    assert len(w) >= 12 and w == [x for x in unicodedata.normalize("NFC", text).split()]
    long, short = " ".join(w[:12]), " ".join(w[:11])
    docs = spark.createDataFrame([(1, f"x {long} y"), (2, f"x {short} y"), (3, unicodedata.normalize("NFD", long))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, text)], "item_id bigint, text string")
    assert sorted(r.doc_id for r in leakage.leaks(docs, items).collect()) == [1, 3]
