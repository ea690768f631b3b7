import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from quillmark.functions import spans
from quillmark.functions import text as T
from quillmark.functions.math import half_up
from quillmark.plans.audience import verdict


def one(spark, c, text):
    return spark.createDataFrame([(text,)], "t string").select(c.alias("x")).first().x


@pytest.mark.parametrize("text,want", [("losu kuthi show", "l*** k**** show"), ("you idiots are stupid", "you i***** are s*****"), ("Scunthorpe Dickens kuthikum", "Scunthorpe Dickens kuthikum"), ("லூசு", "லூ*"), ("", ""), (None, None)])
def test_mask(spark, text, want):
    assert one(spark, T.mask(F.col("t")), text) == want


def test_redaction(spark):
    text = "mail a.b+c@d.org, id 1234 5678 9012, call +91 98765 43210"
    assert one(spark, T.redact_v1(F.col("t")), text) == "mail [EMAIL], id [ID], call [PHONE]"
    clean, n = T.redact_v2(F.col("t"))
    assert one(spark, clean, "id 1234-5678-9012 x@y.org") == "id [ID] [EMAIL]"
    assert one(spark, n["emails"], "x@y.org and z@y.org") == 2


def test_hmac(spark):
    assert one(spark, T.hmac_sha256(b"key", F.col("t")), "author") == hmac.new(b"key", b"author", hashlib.sha256).hexdigest()


def test_hash_normal(spark):
    assert one(spark, T.hash_normal(F.col("t")), " RT @x: Hello  WORLD https://a.b ") == "hello world"


def test_nfkc(spark):
    assert one(spark, T.nfkc(F.col("t")), "\uff21\uff42\u00bd") == "Ab1\u20442"
    assert one(spark, T.nfkc(F.col("t")), None) is None


@pytest.mark.parametrize("text,want", [("I will kill him", "threat"), ("I will not kill him", None), ('he said "I will kill you"', None), ("you are a moron", "check"), ("naan unna konnuduven", "threat"), ("main tujhe jaan se maar dunga", "threat"), ("கொன்னுடுவேன்", "threat"), ("rain is likely today", None), ("", None), (None, None)])
def test_threat_hint(spark, text, want):
    got = one(spark, T.threat_hint(F.col("t")), text)
    assert got == want or want is None and got == "check" and "kill" in text


def test_sarcasm_and_empty(spark):
    assert one(spark, F.array_join(T.sarcasm_markers(F.col("t")), "|"), "Yeah right, nice job \U0001f644") == "yeah right|nice job|positive_words_with_negative_emoji"
    for text, want in (("https://a.b @you \U0001f600 !!", True), ("@you hi", False), ("", True)):
        assert one(spark, T.empty_after_clean(F.col("t")), text) is want


def test_english(spark):
    hits, ratio, n = T.english_evidence(F.col("t"))
    assert one(spark, F.struct(hits, F.round(ratio, 2), n), "I'm so cold, it's so cold") == (3, 0.67, 6)
    assert one(spark, T.distinctive_hits(F.col("t")), "que me muera no") == 0


def test_events(spark):
    pol, sev, cats = T.event_signal(F.col("t"))
    assert one(spark, pol, "heavy flooding, ndrf deployed") == "negative"
    assert one(spark, sev, "heavy flooding, ndrf deployed") == 0.85
    assert one(spark, pol, "a quiet day") == "none"
    assert one(spark, F.array_join(cats, " "), "flood and riot") == "disaster violence"


def test_video_id(spark):
    for url in ("https://youtu.be/abcdefghijk", "https://www.youtube.com/watch?v=abcdefghijk&t=1", "http://m.youtube.com/shorts/abcdefghijk"):
        assert one(spark, T.video_id(F.col("t")), url) == "abcdefghijk"
    for url in ("https://evil.com/watch?v=abcdefghijk", "https://youtube.com/playlist?list=x", "file:///x", ""):
        assert one(spark, T.video_id(F.col("t")), url) is None


def test_half_up(spark):
    assert one(spark, half_up(F.lit(0.285), 2), "") == 0.28


@pytest.mark.parametrize("score,english,threat,want", [(0.05, True, False, "clean"), (0.55, True, False, "rude"), (0.95, True, False, "severe"), (0.1, True, True, "severe"), (0.35, False, False, "unsure"), (0.35, True, False, "clean"), (None, True, False, "unavailable")])
def test_verdict(spark, score, english, threat, want):
    assert one(spark, verdict(F.lit(score).cast("double"), F.lit(english), F.lit(threat)), "") == want


def test_spans():
    assert [k for k, _, _ in spans.claimed("see https://a.b/#x @you #Tag 12")] == ["url", "mention", "hashtag", "number"]
    assert spans.hashtag_words("#SaveTirunelveli") == ["save", "tirunelveli"]
    assert spans.shortened("loveeee gooooood", {"love", "good"}) == "love good"
    assert spans.analysis_text("RT @citizen: OMG!!! #SaveTirunelveli This is amazing!!", set()) == "RT : OMG !!! save tirunelveli This is amazing !!"
    assert spans.first_json('```json {"items":[{"id":"a","evidence":"x}\\"y"}]} ``` more') == {"items": [{"id": "a", "evidence": 'x}"y'}]}
    assert spans.first_json("none") is None
    assert spans.spans_of("a!! \U0001f600") == [("repeated", 1, 3), ("emoji", 4, 5)]
    cost = spans.word_costs({"save": 5, "the": 9, "lake": 2, "sav": 1})
    assert spans.hashtag_words("#savethelake", cost) == ["save", "the", "lake"] and spans.hashtag_words("#zzqq", cost) == ["zzqq"]
    assert spans.nlp_text("see https://a.b @you #BigDay wow!!!", set()) == "see you big day wow!"


def test_with_spans(spark):
    df = spark.createDataFrame([(1, "hi @you"), (2, None), (3, "")], "id int, t string").withColumn("spans", F.lit("clash"))
    got = {r.id: r for r in spans.with_spans(df, "id", "t").collect()}
    assert got[1].spans[0].text == "@you" and got[2].spans is None and got[3].spans == []


def test_salvage():
    from quillmark.functions.answers import objects

    assert objects('```json\n[{"id":"b"}]\n``` trailing') == [{"id": "b"}]
    assert objects('[{"id":"a","label": neutral, "r":"x}\\"y"},{"id":"b","label":"positive"},{"id":"cut') == [{"id": "a", "label": "neutral", "r": 'x}"y'}, {"id": "b", "label": "positive"}]
    assert objects(None) == [] and objects("no") == [] and objects('{"id": 1}') == [{"id": 1}]


def test_segment_and_estimate_rules(spark):
    from quillmark.functions.answers import valid_estimate, valid_segment

    text = F.lit("As a student I think the buses are far too late every single day")
    seg = lambda s, e, c: one(spark, valid_segment(text, F.lit(s), F.lit(e).cast("string"), F.lit(c).cast("double")), "")
    assert tuple(seg("student", "as a student", 0.905)) == ("student", "as a student", 0.91)
    for s, e, c in (("student", "the buses", 0.9), ("student", "as a student", 0.5), ("king", "as a student", 0.9), ("student", None, 0.9), ("student", "I am not there", 0.9)):
        assert seg(s, e, c).id == "unstated"
    est = lambda *a: tuple(one(spark, valid_estimate(*[F.lit(x) for x in a[:4]], F.lit(a[4])), ""))
    assert est("18-24", "male", "in", "tamil NADU", 0.5) == ("18-24", "male", "IN", "Tamil Nadu", 0.5)
    assert est("18", "x", "US", "Tamil Nadu", 0.5) == (None, None, "US", None, 0.5) and est("18-24", "male", "IN", "Goa", 0.3) == (None,) * 5
