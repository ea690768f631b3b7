import json
import struct
import zlib

import pytest

from quillmark.sources import files, media, paged


def test_csv_tables(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿Viewer age,Views\nAge 18-24,5\n\"age 25_34\", 15 \nTotal,20\n,\n", encoding="utf-8")
    got = {r.label: (r.percent, r["count"]) for r in files.studio_shares(files.csv_table(spark, str(p))).collect()}
    assert got == {"18–24": (25.0, 5), "25–34": (75.0, 15)}
    p.write_text("dimension,label,count\nage,a,1\nage,b,3\nshoe,c,9\n")
    got = {r.label: r.percent for r in files.survey_shares(files.csv_table(spark, str(p))).collect()}
    assert got == {"a": 25.0, "b": 75.0}
    with pytest.raises(ValueError):
        files.studio_shares(spark.createDataFrame([("a", "b")], "x string, y string"))


def test_violations(spark):
    rows = [("age", "a", 60.0), ("age", "A", 50.0), ("shoe", "x", 1.0), ("gender", "a@b", 5.0)]
    got = {r["constraint"] for r in files.share_violations(spark.createDataFrame(rows, "dimension string, label string, percent double")).collect()}
    assert got == {"dimension", "label", "repeated", "more than all"}


def test_snapshot_and_lines(spark, tmp_path):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.StringType())])
    assert files.snapshot(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "g.jsonl").write_text('// note\n{"label":"GPE","pattern":"Chennai"}\n\n')
    assert [r.pattern for r in files.commented_lines(spark, str(tmp_path / "g.jsonl"), "label string, pattern string").collect()] == ["Chennai"]


def png(*chunks):
    out = b"\x89PNG\r\n\x1a\n"
    for name, body in ((b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)), *chunks, (b"IEND", b"")):
        out += struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return out


def test_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png((b"tEXt", b"parameters\0steps: 20"), (b"IDAT", b"trainedAlgorithmicMedia")))
    (tmp_path / "b.png").write_bytes(png((b"IDAT", b"trainedAlgorithmicMedia")))
    (tmp_path / "c.png").write_bytes(b"xx")
    jpeg = b"\xff\xd8" + b"\xff\xe1" + struct.pack(">H", 2 + 30) + b"xmp trainedAlgorithmicMedia  x".ljust(30)[:30] + b"\xff\xc0" + struct.pack(">HBHH", 7, 8, 11, 13) + b"\xff\xda"
    (tmp_path / "d.jpg").write_bytes(jpeg)
    df = media.images(files.binary(spark, str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: r.image for r in df.select("path", "image").collect()}
    assert (got["a.png"].width, got["a.png"].height) == (7, 5) and got["c.png"].type == "unknown" and (got["d.jpg"].width, got["d.jpg"].height) == (13, 11)
    signals = {(r.path.rsplit("/", 1)[1], r.kind) for r in media.label_signals(df).collect()}
    assert signals == {("a.png", "generator_settings"), ("d.jpg", "source_type")}


def box(name, body):
    return struct.pack(">I", 8 + len(body)) + name + body


def test_frames():
    tkhd = box(b"tkhd", struct.pack(">I", 0) + b"\0" * 8 + struct.pack(">I", 1) + b"\0" * 60 + struct.pack(">II", 640 << 16, 480 << 16))
    mdhd = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 1000, 0))
    hdlr = box(b"hdlr", struct.pack(">II", 0, 0) + b"vide")
    stts = box(b"stts", struct.pack(">IIII", 0, 1, 3, 40))
    moov = box(b"moov", box(b"trak", tkhd + box(b"mdia", mdhd + hdlr + box(b"minf", box(b"stbl", stts)))))
    got = media.frame_times(box(b"ftyp", b"isom") + moov)
    assert got == {"width": 640, "height": 480, "duration": 0.12, "frame_times": [0.0, 0.04, 0.08]}
    assert media.frame_times(b"") is None and media.frame_times(None) is None and media.frame_times(b"\0\0\0\x08ftyp") is None


def test_paged(spark, tmp_path):
    for c in ("x", "y"):
        (tmp_path / c).mkdir()
        for i in (1, 2):
            items = [{"id": f"{c}{i}{j}", "text": "t", "likes": j} for j in range(2)]
            (tmp_path / c / f"{i}.json").write_text(json.dumps({"items": items, "next": "2"}))
    paged.register(spark)
    assert spark.read.format("paged").load(str(tmp_path)).count() == 8
    assert spark.read.format("paged").option("maxItems", 3).load(str(tmp_path)).count() == 6


def test_retries():
    calls = []

    def get(page):
        calls.append(page)
        if len(calls) < 3:
            raise paged.RetryLater(0)
        return {"items": []}

    assert paged.fetched(get, "1", sleep=lambda s: None) == {"items": []}
    with pytest.raises(paged.RetryLater):
        paged.fetched(lambda p: (_ for _ in ()).throw(paged.RetryLater(99)), "1", sleep=lambda s: None)
