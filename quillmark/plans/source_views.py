"""Readers over small tables written for them, and media made by hand; each against what must come out."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.plans.base import query
from quillmark.session import checkpoint_dir
from quillmark.sources import files, media, paged
from quillmark.sources.tables import table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/quillmark/{name}-{uuid.uuid4().hex}"


def _by_nation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name", "n")


@query("""WITH c AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT 'country' AS dimension, n_name AS label, floor(n / (SELECT sum(n) FROM c)::DOUBLE * 100 * 100 + 0.5) / 100 AS percent, n AS count FROM c""")
def studio_csv(spark: SparkSession, d: str) -> DataFrame:
    """An exported table in CSV: dimension told by its header, quoted cells, counts with commas, a total row and blank rows."""
    path = _folder(spark, "studio")
    rows = _by_nation(spark, d).select(F.concat(F.lit(" "), "n_name").alias("Geography"), F.format_number("n", 0).alias("Views"), F.lit('said "so", twice').alias("Note"))
    rows.unionByName(spark.createDataFrame([("Total", "9", None), (None, None, None)], "Geography string, Views string, Note string")).coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return files.studio_shares(files.csv_table(spark, path))


@query("""WITH c AS (SELECT CASE WHEN n_regionkey < 2 THEN 'age' ELSE 'gender' END AS dimension, n_name AS label, count(*) AS count FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4 GROUP BY ALL) SELECT dimension, label, count, floor(count * 100.0::DOUBLE / sum(count) OVER (PARTITION BY dimension) * 100 + 0.5) / 100 AS percent FROM c""")
def survey_csv(spark: SparkSession, d: str) -> DataFrame:
    """A survey in CSV as percents within each dimension; unknown dimensions are left out."""
    path = _folder(spark, "survey")
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("count")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    kind = F.when(F.col("n_regionkey") < 2, "Age").when(F.col("n_regionkey") < 4, "gender").otherwise("shoe")
    n.select(kind.alias("Dimension"), F.col("n_name").alias("Label"), "count").write.option("header", True).csv(path)
    return files.survey_shares(files.csv_table(spark, path)).select("dimension", "label", "count", "percent")


@query("""WITH r AS (SELECT CASE WHEN n_regionkey < 2 THEN 'age' WHEN n_regionkey < 4 THEN 'gender' ELSE 'religion' END AS dimension, n_name AS label, n_nationkey * 3.0::DOUBLE AS percent FROM nation)
SELECT 'dimension' AS "constraint", dimension, label FROM r WHERE dimension = 'religion' UNION ALL SELECT 'more than all', dimension, NULL FROM r GROUP BY dimension HAVING sum(percent) > 100.5 UNION ALL SELECT 'label', 'age', 'mail@x' UNION ALL SELECT 'count', 'age', 'minus' UNION ALL SELECT 'percent', 'age', 'much' UNION ALL SELECT 'null percent', 'age', 'unsaid' UNION ALL SELECT 'repeated', 'age', lower(n_name) FROM nation WHERE n_regionkey = 0 QUALIFY row_number() OVER (ORDER BY n_name) = 1""")
def share_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Broken constraints of an imported table of shares, some of them planted."""
    n = table(spark, d, "nation")
    r = n.select(F.when(F.col("n_regionkey") < 2, "age").when(F.col("n_regionkey") < 4, "gender").otherwise("religion").alias("dimension"), F.col("n_name").alias("label"), (F.col("n_nationkey") * 3.0).alias("percent"), F.lit(7).cast("bigint").alias("count"), F.lit(False).alias("suppressed"))
    first = r.filter("dimension = 'age'").join(n.filter("n_regionkey = 0").select(F.min("n_name").alias("label")), "label").select("dimension", F.lower("label").alias("label"), F.lit(0.0).alias("percent"), "count", "suppressed")
    bad = spark.createDataFrame([("age", "mail@x", 0.0, 1, False), ("age", "minus", 0.0, -1, False), ("age", "much", 101.0, 1, False), ("age", "unsaid", None, 1, False)], r.schema)
    return files.share_violations(r.unionByName(first).unionByName(bad))


@query("SELECT label, pattern FROM (SELECT 'GPE' AS label, n_name AS pattern FROM nation)")
def commented_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of JSON among comments, blank and broken lines."""
    path = _folder(spark, "lines")
    n = table(spark, d, "nation").select(F.to_json(F.struct(F.lit("GPE").alias("label"), F.col("n_name").alias("pattern"))).alias("value"))
    n.unionAll(spark.createDataFrame([("// note",), ("",), ("  // more",), ("{broken",)], "value string")).write.text(path)
    return files.commented_lines(spark, path, "label string, pattern string").filter("label is not null")


@query("SELECT n_nationkey, n_name FROM nation")
def snapshot_scan(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot in JSON; one that is missing adds no rows."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    path = _folder(spark, "snapshot")
    n.agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value")).write.text(path)  # one array of 25 rows
    kind = n.schema
    return files.snapshot(spark, path, kind).unionByName(files.snapshot(spark, path + "-none", kind))


@query("SELECT r_name AS collection, n_name AS id, CAST(n_nationkey AS BIGINT) AS likes FROM nation JOIN region ON n_regionkey = r_regionkey")
def paged_scan(spark: SparkSession, d: str) -> DataFrame:
    """Collections of pages of two items, each naming the next; the last names itself, which ends the walk."""
    root = Path(unquote(urlparse(_folder(spark, "pages")).path))
    pages = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name", "n_nationkey").collect()  # 25 rows
    for name in sorted({r.r_name for r in pages}):
        own = sorted((r for r in pages if r.r_name == name), key=lambda r: r.n_nationkey)
        (root / name).mkdir(parents=True)
        last = -(-len(own) // 2)
        for i in range(last):
            part = [{"id": r.n_name, "likes": r.n_nationkey} for r in own[2 * i : 2 * i + 2]]
            (root / name / f"{i + 1}.json").write_text(json.dumps({"items": part, "next": str(min(i + 2, last))}), encoding="utf-8")
    paged.register(spark)
    return spark.read.format("paged").load(f"file://{root}").select("collection", "id", "likes")


def _png(*chunks: tuple[bytes, bytes]) -> bytes:
    out = b"\x89PNG\r\n\x1a\n"
    for name, body in ((b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)), *chunks, (b"IEND", b"")):
        out += struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return out


def _jpeg(mark: int, body: bytes) -> bytes:
    return b"\xff\xd8\xff" + bytes([mark]) + struct.pack(">H", 2 + len(body)) + body + b"\xff\xc0" + struct.pack(">HBHH", 7, 8, 11, 13) + b"\xff\xda" + b"Midjourney"


def _box(name: bytes, body: bytes) -> bytes:
    return struct.pack(">I", 8 + len(body)) + name + body


def _mp4() -> bytes:
    head = _box(b"tkhd", struct.pack(">I", 0) + b"\0" * 8 + struct.pack(">I", 1) + b"\0" * 60 + struct.pack(">II", 640 << 16, 480 << 16))
    scale, kind = _box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 1000, 0)), _box(b"hdlr", struct.pack(">II", 0, 0) + b"vide")
    steps = _box(b"stts", struct.pack(">IIII", 0, 1, 3, 40))
    return _box(b"ftyp", b"isom") + _box(b"moov", _box(b"trak", head + _box(b"mdia", scale + kind + _box(b"minf", _box(b"stbl", steps)))))


def _media(spark: SparkSession) -> DataFrame:
    made = {
        "settings.png": _png((b"tEXt", b"parameters\0steps: 30")), "pixels.png": _png((b"IDAT", b"trainedAlgorithmicMedia Midjourney")), "named.png": _png((b"tEXt", b"Software\0ComfyUI")),
        "xmp.jpg": _jpeg(0xE1, b"xmp trainedAlgorithmicMedia"), "mixed.jpg": _jpeg(0xE1, b"Exif compositeWithTrainedAlgorithmicMedia"), "manifest.jpg": _jpeg(0xEB, b"JP\0\0jumb c2pa.manifest"), "scan.jpg": _jpeg(0xFE, b"nothing"), "other.bin": b"\1\2\3",
    }
    return spark.createDataFrame(sorted(made.items()), "path string, content binary")


@query("""SELECT * FROM (VALUES ('settings.png', 'generator_settings', 'parameters'), ('named.png', 'generator', 'ComfyUI'), ('xmp.jpg', 'source_type', 'trainedAlgorithmicMedia'), ('mixed.jpg', 'source_type', 'compositeWithTrainedAlgorithmicMedia'), ('manifest.jpg', 'credentials', 'c2pa')) t(path, kind, detail)""")
def media_signals(spark: SparkSession, d: str) -> DataFrame:
    """What the metadata of images says about their making; pixels say nothing."""
    return media.label_signals(media.images(_media(spark)))


@query("""SELECT * FROM (VALUES ('settings.png', 'png', 7, 5, 'labelled_ai', true), ('named.png', 'png', 7, 5, 'labelled_ai', true), ('pixels.png', 'png', 7, 5, 'cant_tell', false), ('xmp.jpg', 'jpeg', 13, 11, 'labelled_ai', true), ('mixed.jpg', 'jpeg', 13, 11, 'labelled_ai', true), ('manifest.jpg', 'jpeg', 13, 11, 'likely_ai', false), ('scan.jpg', 'jpeg', 13, 11, 'unavailable', false), ('other.bin', 'unknown', NULL, NULL, 'no_ai_signs', false)) t(path, kind, width, height, verdict, ai_label)""")
def media_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Kind, size and verdict of images: a label in the file beats the model, a weak finding can't tell."""
    said = spark.createDataFrame([("pixels.png", "likely_ai", 0.3), ("manifest.jpg", "likely_ai", 0.9), ("xmp.jpg", "no_ai_signs", 0.9), ("other.bin", "likely_authentic", 0.9)], "path string, model string, confidence double")
    i = media.images(_media(spark))
    j = i.join(media.labels(i), "path").join(said, "path", "left")
    return j.select("path", F.col("image.type").alias("kind"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), media.verdict(F.col("ai_label"), F.col("model"), F.col("confidence")).alias("verdict"), "ai_label")


@query("SELECT 640 AS width, 480 AS height, 0.12::DOUBLE AS duration, CAST(i AS INTEGER) AS frame, round(i * 0.04, 3)::DOUBLE AS at_seconds FROM range(3) t(i)")
def video_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a video file and their times, from its tables alone."""
    v = media.videos(spark.createDataFrame([("a.mp4", _mp4())], "path string, content binary"))
    return v.select("video.width", "video.height", F.round("video.duration", 6).alias("duration"), F.posexplode("video.frame_times").alias("frame", "at_seconds"))


@query("""WITH b AS (SELECT event_id, (user_id * 37) % 1000 AS l, (user_id * 91) % 1000 AS t, (user_id * 37) % 1000 + CAST(trunc(value) AS INTEGER) % 200 - 20 AS r, (user_id * 91) % 1000 + CAST(trunc(value) AS INTEGER) % 150 - 10 AS u FROM events), c AS (SELECT event_id, l, t, greatest(0, least(1000, r)) AS r, greatest(0, least(1000, u)) AS u FROM b), k AS (SELECT * FROM c WHERE r > l AND u > t)
SELECT event_id, CAST(greatest(0, l - greatest(20, floor((r - l) * 0.25::DOUBLE + 0.5))) AS BIGINT) AS x1, CAST(greatest(0, t - greatest(15, floor((u - t) * 0.15::DOUBLE + 0.5))) AS BIGINT) AS y1, CAST(least(1000, r + greatest(20, floor((r - l) * 0.25::DOUBLE + 0.5))) AS BIGINT) AS x2, CAST(least(1000, u + greatest(15, floor((u - t) * 0.15::DOUBLE + 0.5))) AS BIGINT) AS y2 FROM k""")
def hide_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes clamped to the grid, those inside out dropped, the rest grown to hide what they hold."""
    v = F.col("value").cast("int")
    l, t = (F.col("user_id") * 37) % 1000, (F.col("user_id") * 91) % 1000
    b = media.clean_box(F.array(l, t, l + v % 200 - 20, t + v % 150 - 10).cast("array<double>"))
    return table(spark, d, "events").select("event_id", media.hide_box(b).alias("b")).filter("b is not null").select("event_id", *[F.col("b")[i].cast("bigint").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT user_id AS frame, CAST(min(CAST(trunc(value) AS INTEGER)) AS BIGINT) AS x1, CAST(min(event_id % 500) AS BIGINT) AS y1, CAST(max(CAST(trunc(value) AS INTEGER) + 10) AS BIGINT) AS x2, CAST(max(event_id % 500 + 20) AS BIGINT) AS y2 FROM events GROUP BY user_id")
def tracked_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The box around all boxes of each frame."""
    v, e = F.col("value").cast("int").cast("bigint"), (F.col("event_id") % 500).cast("bigint")
    b = table(spark, d, "events").select(F.col("user_id").alias("frame"), F.array(v, e, v + 10, e + 20).alias("b"))
    return media.tracked(b, "frame", "b").select("frame", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("""WITH r AS (SELECT user_id, event_type AS what, event_type IN ('click', 'view') AS privacy, user_id % 2 = 0 AS harmful FROM events) SELECT user_id, coalesce(string_agg(DISTINCT what, ' ' ORDER BY what) FILTER (privacy OR harmful), '') AS hidden FROM r GROUP BY user_id""")
def hidden_regions(spark: SparkSession, d: str) -> DataFrame:
    """Names of what is hidden: private details always, the rest where the image is harmful."""
    r = table(spark, d, "events").select("user_id", F.col("event_type").alias("what"), F.col("event_type").isin("click", "view").alias("privacy")).distinct()
    g = r.groupBy("user_id").agg(F.collect_list(F.struct("what", "privacy")).alias("regions"))
    return g.select("user_id", F.array_join(media.visible_regions(F.col("regions"), F.col("user_id") % 2 == 0), " ").alias("hidden"))


@query("""WITH s AS (SELECT user_id, event_type AS what, round(value) AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events) SELECT user_id, CAST(count(*) FILTER (what <> 'view') AS INTEGER) AS signs, coalesce(string_agg(what, ' ' ORDER BY rn) FILTER (what <> 'view'), '') AS kinds FROM s WHERE rn <= 4 GROUP BY user_id""")
def assessed_signs(spark: SparkSession, d: str) -> DataFrame:
    """The first four signs of each answer, those without a reason dropped."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    first = table(spark, d, "events").withColumn("rn", F.row_number().over(w)).filter("rn <= 4")
    why = F.when(F.col("event_type") == "view", "  ").otherwise("looks odd")
    g = first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.struct(F.col("event_type").alias("what"), why.alias("why"), F.array(F.lit(0.0), F.lit(0.0), F.col("value"), F.lit(9.0)).alias("box")).alias("s")))), lambda x: x["s"]).alias("signs"))
    c = media.clean_assessment(F.col("signs"))
    return g.select("user_id", F.size(c).alias("signs"), F.array_join(F.transform(c, lambda x: x["what"]), " ").alias("kinds"))
