"""Problems 2, 3, 4, 5, 7: text operators against small cases and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.llm import abuse, format_dups, language, lookalike, pii

POSTS = "post_id string, original_text string, processed_at timestamp, table_name string, lang string"


def posts(spark, texts):
    rows = [(f"x:{i:03d}", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "post_id string, original_text string")
    # names that clash with what the operators add
    return df.withColumn("processed_at", F.lit("2026-01-01").cast("timestamp")).withColumn("form", F.lit(1)).withColumn("id", F.lit(2)).withColumn("score", F.lit(None).cast("int"))


# --- problem 5

SAME = [["office", "oﬃce", "оffice", "of​fice"], ["Ａ b", "A b"], ["café", "café"]]


def test_look_classes_are_transitive():
    table = lookalike.classes({"a": 10, "а": 3, "ａ": 2, "é": 5, "é": 1, "е́": 1})
    r = lookalike.Rewriter(table)
    assert r("аａa") == "aaa" and r("е́") == r("é") == "é"
    assert lookalike.Rewriter(lookalike.classes({"а": 10, "a": 3}))("aа") == "аа"  # the frequent one represents


def test_joiners_stay_where_they_draw():
    r = lookalike.Rewriter(lookalike.classes({"a": 1}))
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    assert r(family) == family and r("क्‍ष") == "क्‍ष" and r("a‍b") == "ab"


def test_same_look_pairs(spark):
    texts = [t for g in SAME for t in g] + ["Office", "office ", "office", None, "", "x" * 50_000 + "а", "x" * 50_000 + "a"]
    df = posts(spark, texts)
    pairs = {(r.post_id_a, r.post_id_b) for r in lookalike.same_look_pairs(lookalike.form_digests(df, "post_id", "original_text", "processed_at")).collect()}
    r = lookalike.Rewriter(lookalike.rewrite_table(df, "original_text"))
    form = [None if t is None else r(t) for t in texts]
    want = {(f"x:{i:03d}", f"x:{j:03d}") for i in range(len(texts)) for j in range(i + 1, len(texts)) if form[i] is not None and form[i] == form[j] and texts[i] != texts[j]}
    assert pairs == want and ("x:000", "x:001") in pairs and not any("x:009" in p for p in pairs)
    groups = {r.post_id: r for r in lookalike.look_groups(lookalike.form_digests(df, "post_id", "original_text", "processed_at")).collect()}
    assert groups["x:000"].members == 5 and groups["x:000"].spellings == 4


def test_consistent_text_nulls(spark):
    out = {r.post_id: r.consistent_text for r in lookalike.consistent_text(posts(spark, [None, "", "ab"]), "post_id", "original_text", "processed_at").collect()}
    assert out == {"x:000": None, "x:001": "", "x:002": "ab"}
    assert lookalike.consistent_text(posts(spark, ["a"]).limit(0), "post_id", "original_text", "processed_at").count() == 0


# --- problem 4


def test_format_duplicates_against_brute_force(spark):
    rng = random.Random(1)
    base = ["the road is closed", "straße gesperrt", "area: A; issue: lamp; ward: 3", "சாலை மூடி", "a b", "ab", "🔥🔥", "...", None, "", "12:30 / 14:00"]
    texts = list(base)
    for _ in range(120):
        t = rng.choice([b for b in base if b])
        if rng.random() < 0.5:
            t = t.upper()
        if ":" in t and ";" in t and rng.random() < 0.6:
            f = [x.strip() for x in t.split(";")]
            rng.shuffle(f)
            t = rng.choice([" / ", ";", "\n"]).join(f)
        if rng.random() < 0.4:
            t = "  ".join(t.split(" ")) + rng.choice(["!", " .", "\t"])
        if rng.random() < 0.3:
            t = t.replace("a", "а")
        texts.append(t)
    df = posts(spark, texts)
    got = {r.post_id: (r.first_post_id, r.copies) for r in format_dups.format_duplicates(df, "post_id", "original_text", "processed_at").collect()}
    r = lookalike.Rewriter(lookalike.rewrite_table(df, "original_text"))
    groups = {}
    for i, t in enumerate(texts):
        if t and any(c.isalnum() for c in t):
            groups.setdefault(format_dups.exact_key(r(t)), []).append(f"x:{i:03d}")
    want = {p: (min(g), len(g)) for g in groups.values() for p in g}
    assert got == want
    kept = format_dups.kept_posts(format_dups.format_duplicates(df, "post_id", "original_text", "processed_at"))
    assert kept.agg(F.sum("copies")).first()[0] == len(want)


def test_fields():
    k = format_dups.exact_key
    assert k("Area: X; Ward: 3") == k("ward : 3 / AREA: x") and k("area: x; ward: 3") != k("area: 3; ward: x")
    assert k("see https://a.b/c, d: e") == k("See https://a.b/c d: e")


# --- problem 7

CASES = [
    ("my mail is a.b+c@mail.org ok", {"EMAIL"}), ("write to ann-lee (at) mail [dot] org", {"EMAIL"}), ("ann_lee23 at mail dot org please", {"EMAIL"}),
    ("call me on +44 7700 900401", {"PHONE"}), ("call zero seven seven zero zero nine zero zero one two three", {"PHONE"}), ("whatsapp ０７７００ ９００１２０", {"PHONE"}),
    ("my id number is 1234 5678 9012", {"ID"}), ("tax id 000-12-3456", {"ID"}), ("card 4111 1111 1111 1111 was rejected", {"ID"}), ("id ABCDE1234F", {"ID"}), ("iban GB82 WEST 1234 5698 7654 32", {"ID"}),
    ("i live at 12 Mill Road, Town", {"ADDRESS"}), ("vivo en calle Mayor 10", {"ADDRESS"}), ("ich wohne in Ort, Hauptstraße 9", {"ADDRESS"}), ("j'habite au 8 bis, rue Hugo", {"ADDRESS"}),
    ("my name is Anna Lindt", {"NAME"}), ("Mr Tom Ford signed", {"NAME"}), ("mein Name ist Uwe Klein", {"NAME"}),
    ("score was 118-115-91", set()), ("tender closed on 2024-05-06", set()), ("views crossed 1,925,225 today", set()), ("thanks @ward_watch_9", set()), ("[EMAIL] and [PHONE]", set()),
    ("main road towards the lake is closed", set()), ("the street waited 40 hours", set()), ("my name is the best of all", set()), ("la calle lleva 36 días así", set()), ("ticket TKT-5555/7 is open", set()), ("", set()),
]


@pytest.mark.parametrize("text,want", CASES)
def test_pii_types(text, want):
    assert {k for *_, k, _ in pii.spans(text)} == want


def test_checksums():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    assert pii.verhoeff("2363") and not pii.verhoeff("2364")


def test_redaction_round_trip(spark):
    text = "hі my nаme is Anna Lindt, a.b＠mail.org" + " x" * 20_000
    df = posts(spark, [text, None, ""])
    got = {r.post_id: r for r in pii.personal_data(df, "post_id", "original_text", "processed_at").collect()}
    r = got["x:000"]
    assert r.redacted_text.startswith("hі my nаme is [NAME], [EMAIL]") and text[r.finds[0].start : r.finds[0].end] == "Anna Lindt"
    assert got["x:001"].redacted_text is None and got["x:002"].redacted_text == ""
    types = {(r.post_id, r.pii_type) for r in pii.found_types(df, "post_id", "original_text", "processed_at").collect()}
    assert types == {("x:000", "NAME"), ("x:000", "EMAIL")}


# --- problem 3

ABUSE = ["shut up you moron", "you are such a w0rthless idi0t", "halt die fresse du Drecksack", "those neighbours are cockroaches and must be thrown out", "jump in front of the next train", "send me your nude pics", "you m o r o n", "shut up you p.i.g", "free p*rn cams", "cállate gilipollas de mierda", "yоu аre such а pathetic lоser", "இந்த லூசு எல்லாம் மனுஷனே இல்லை"]
HARMLESS = ["he said somebody called him a moron and that is not fair", "please stop calling them idiots", "rats chewed the cable", "the garbage truck skipped our lane", "the sex ratio figures were published", "my exam nearly killed me but i passed", "class assessment and cocktail", "a slap of cold wind", "kill the street lights by day", "", "the price of naali work"]


@pytest.mark.parametrize("text", ABUSE)
def test_abuse(text):
    assert abuse.Scorer().score(text)[0] >= abuse.LEAST


@pytest.mark.parametrize("text", HARMLESS)
def test_harmless(text):
    assert abuse.Scorer().score(text)[0] < abuse.LEAST


def test_automaton_against_brute_force():
    def distance(a, b):
        d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
        return d[-1][-1]

    rng = random.Random(2)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    lex = abuse.Lexicon({t: ("insult", 0.5) for t in terms})
    for _ in range(300):
        w = "".join(rng.choice("abc") for _ in range(rng.randint(5, 10)))
        limit = lex.edits(w)
        near = [distance(w, t) for t in lex.terms if t[0] == w[0]]
        got = lex.match(w)
        best = min(near, default=99)
        assert (got[1] if got else None) == (best if best <= limit else None)


def test_scores_and_rates(spark):
    df = posts(spark, [ABUSE[0], HARMLESS[0], None, "word " * 20_000]).withColumn("source", F.lit("s"))
    s = abuse.scored(df, "post_id", "original_text", "processed_at", "source")
    assert s.filter("score is null").count() == 1
    r = abuse.rates(s, "source").first()
    assert (r.posts, r.flagged) == (3, 1)


# --- problem 2

SENTENCES = {
    "en": ["the road near the market is still closed today", "please clean the drain before the rain comes", "nobody answered the phone for three weeks", "we all went to the new station yesterday"],
    "es": ["la calle cerca del mercado sigue cerrada hoy", "por favor limpien el canal antes de la lluvia", "nadie contestó el teléfono durante semanas", "ayer fuimos todos a la nueva estación"],
    "de": ["die Straße am Markt ist heute noch gesperrt", "bitte reinigt den Kanal vor dem Regen", "niemand hat seit Wochen ans Telefon gehört", "gestern waren wir alle am neuen Bahnhof"],
}


def samples(n, wrong=0.1, seed=3):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        c = rng.choice(list(SENTENCES))
        words = " ".join(rng.choice(SENTENCES[c]) for _ in range(2))
        out.append((words, rng.choice(list(SENTENCES)) if rng.random() < wrong else c, c))
    return out


def test_codes():
    assert [language.code(x) for x in ("en-US", "ENG", "Tamil", "hi-Latn", "pt_BR", " fr ", "und", "xx", "", None)] == ["en", "en", "ta", "hi", "pt", "fr", None, None, None, None]


def test_language_model_held_out_accuracy():
    m = language.train([(t, said) for t, said, _ in samples(240)])
    held = samples(100, seed=9)
    assert sum(m.read(t)["lang"] == true for t, _, true in held) >= 98
    mixed = m.read("please clean the drain before the rain comes. nadie contestó el teléfono durante semanas")
    assert mixed["mixed"] and mixed["langs"] == ["en", "es"] and len(mixed["segments"]) == 2
    assert m.read("the road near the market is closed Hola")["mixed"] is False
    assert m.read("🔥 123 @you https://a.b") is None and 0 <= mixed["confidence"] <= 1


def test_label_faults(spark):
    rows = [(f"x:{i}", t, said if i else None) for i, (t, said, _) in enumerate(samples(200))] + [("x:empty", "", "en"), ("x:null", None, "en")]
    df = spark.createDataFrame(rows, "post_id string, original_text string, lang_hint string").withColumn("received_at", F.lit("2026-01-01").cast("timestamp")).withColumn("lang", F.lit(5))
    found = language.languages(df, "post_id", "original_text", "received_at", "lang_hint")
    info = spark.createDataFrame([("x:0", "xx", True), ("x:1", None, None)], "post_id string, primary_lang string, is_code_mixed boolean")
    truth = {f"x:{i}": (said if i else None, true) for i, (_, said, true) in enumerate(samples(200))}
    got = {(r.post_id, r.field_name): r.lang for r in language.label_faults(found, info).collect()}
    assert {p for p, f in got if f == "lang_hint"} == {p for p, (said, true) in truth.items() if said != true}
    assert ("x:0", "primary_lang") in got and ("x:1", "primary_lang") in got and ("x:0", "is_code_mixed") in got and ("x:1", "is_code_mixed") not in got


def test_misspelt_mild_and_unquoted_insults():
    s = abuse.Scorer()
    for t in ("the mayor is an idoit", "you clown", "du Depp", "stop lying you moron"):
        assert s.score(t)[0] >= abuse.LEAST, t
    for t in ("they called you a moron", "you fool around too much", "naangaaaa vandhu paathom", "the word idiot is wrong", "stop calling people idiots"):
        assert s.score(t)[0] < abuse.LEAST, t


def test_texts_stay_where_they_are_read(spark, data):
    """No exchange of these plans moves a column of texts."""
    from quillmark.llm import queries as Q

    for name in ("p4_found", "p5_found", "p7_found"):
        plan = Q.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan
        for line in plan.split("\n"):
            assert not ("Exchange" in line and "original_text" in line), name


def test_ornate_letters_are_composed():
    marks = "\u0323\u0301\u0302\u0303\u0304"
    r = lookalike.Rewriter(lookalike.classes({"e": 5, "a": 5}))
    assert r("e" + marks + "x") == r("\u1eb9" + marks[1:] + "x")


def test_pairs_of_a_split_class(spark, monkeypatch):


    rows = [(f"p{i:03}", b"f", bytes([i % 3])) for i in range(60)] + [("q", b"g", b"x")]
    df = spark.createDataFrame(rows, "id string, form binary, raw binary")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] != b[2] and a[0] < b[0]}
    monkeypatch.setattr(lookalike, "AT_ONCE", 7)
    got = [tuple(r) for r in lookalike.same_look_pairs(df).collect()]
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("text,bad", [("you absolute numpty, shut up", True), ("what a wally you are", True), ("hope your house floods, you deserve it", True), ("those people should all be drowned", True), ("I will end you tonight", True), ("we will beat them in the final by ten runs", False), ("I hope the drain gets fixed before somebody dies", False), ("you should not be beaten", False), ("they should be told that people die here", False), ("I hope you feel better soon", False)])
def test_harm_by_context(text, bad):
    assert (abuse.Scorer().score(text)[0] >= abuse.LEAST) is bad


@pytest.mark.parametrize("text,name", [("please give this to Rajesh Kumar", "Rajesh Kumar"), ("my friend Priya Nair saw it", "Priya Nair"), ("Anna Lindt will collect it tomorrow", "Anna Lindt"), ("mi vecino Juan Pérez llegó tarde", "Juan Pérez"), ("The Town Council said no", None), ("we met near Green Park yesterday", None), ("deliver it to Green Park", None), ("Please Give This To The Night Shift Today", None)])
def test_names_by_context(text, name):
    found = [text[a:b] for a, b, k, _ in pii.spans(text) if k == "NAME"]
    assert found == ([name] if name else [])
