"""Metadata of image and video files; pixel data is never decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# PNG text keys that only image generators write.
GENERATOR_KEYS = ("parameters", "prompt", "workflow", "invokeai_metadata", "sd-metadata")
# Source types of media made or changed by a model.
SOURCE_TYPES = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia")
# Tools that write their name into the files they make.
GENERATORS = ("Midjourney", "DALL-E", "DALL·E", "Stable Diffusion", "Adobe Firefly", "Imagen", "Muse Image", "NovelAI", "Leonardo.Ai", "ComfyUI", "Flux", "Ideogram", "Meta AI")
# Verdicts, kinds of harm.
VERDICTS = ("likely_ai", "no_ai_signs", "cant_tell")
GRID = 1000
BLOCKS = "struct<type: string, width: int, height: int, blocks: array<struct<kind: string, body: binary>>>"
FRAMES = "struct<width: int, height: int, duration: double, frame_times: array<double>>"


def _chunks(b: bytes, at: int, head: str, tail: int, even: bool = False) -> Iterator[tuple[str, bytes]]:
    """Chunks of a RIFF- or PNG-like file: head is the layout of (size, name) or (name, size)."""
    while at + 8 <= len(b):
        one, two = struct.unpack_from(head, b, at)
        size, name = (one, two) if isinstance(one, int) else (two, one)
        yield name.decode("latin1"), b[at + 8 : at + 8 + size]
        at += 8 + size + tail + (size % 2 if even else 0)


def _jpeg(b: bytes) -> tuple[int | None, int | None, list]:
    width = height = None
    blocks, at = [], 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        mark = b[at + 1]
        if 0xD0 <= mark <= 0xD7:
            at += 2
            continue
        if mark in (0xD9, 0xDA):
            break
        (size,) = struct.unpack_from(">H", b, at + 2)
        body = b[at + 4 : at + 2 + size]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and len(body) >= 5:
            height, width = struct.unpack_from(">HH", body, 1)
        elif 0xE0 <= mark <= 0xEF:
            blocks.append((f"app{mark - 0xE0}", body))
        elif mark == 0xFE:
            blocks.append(("comment", body))
        at += 2 + size
    return width, height, blocks


def _png(b: bytes) -> tuple[int | None, int | None, list]:
    width = height = None
    blocks = []
    for name, body in _chunks(b, 8, ">I4s", 4):
        if name == "IHDR" and len(body) >= 8:
            width, height = struct.unpack_from(">II", body)
        elif name == "IEND":
            break
        elif name != "IDAT":
            blocks.append((name, body))
    return width, height, blocks


def _webp(b: bytes) -> tuple[int | None, int | None, list]:
    width = height = None
    blocks = []
    for name, body in _chunks(b, 12, "<4sI", 0, even=True):
        if name == "VP8X" and len(body) >= 10:
            width, height = (1 + int.from_bytes(body[i : i + 3], "little") for i in (4, 7))
        elif name == "VP8 " and width is None and len(body) >= 10:
            width, height = (x & 0x3FFF for x in struct.unpack_from("<HH", body, 6))
        elif name == "VP8L" and width is None and len(body) >= 5:
            (v,) = struct.unpack_from("<I", body, 1)
            width, height = (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1
        if name not in ("VP8 ", "VP8L", "ANMF", "ALPH"):
            blocks.append((name, body))
    return width, height, blocks


def _gif(b: bytes) -> tuple[int | None, int | None, list]:
    at = b.find(b"XMP DataXMP")
    width, height = struct.unpack_from("<HH", b, 6) if len(b) >= 10 else (None, None)
    return width, height, [("xmp", b[at : at + 65536])] if at >= 0 else []


def image_blocks(b: bytes | None) -> dict | None:
    """Type, size and metadata blocks of an image, told by its first bytes; a broken file gives what could be read."""
    if b is None:
        return None
    kinds = [("jpeg", b[:2] == b"\xff\xd8", _jpeg), ("png", b[:4] == b"\x89PNG", _png), ("webp", b[:4] == b"RIFF" and b[8:12] == b"WEBP", _webp), ("gif", b[:6] in (b"GIF87a", b"GIF89a"), _gif)]
    for name, fits, read in kinds:
        if fits:
            try:
                width, height, blocks = read(b)
            except struct.error:
                width, height, blocks = None, None, []
            return {"type": name, "width": width, "height": height, "blocks": [{"kind": k, "body": v} for k, v in blocks]}
    return {"type": "unknown", "width": None, "height": None, "blocks": []}


def _boxes(b: bytes, at: int, end: int) -> Iterator[tuple[str, int, int]]:
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", b, at)
        head = 8
        if size == 1 and at + 16 <= end:
            (size,) = struct.unpack_from(">Q", b, at + 8)
            head = 16
        stop = end if size == 0 else at + size
        if stop < at + head or stop > end:
            return
        yield name.decode("latin1"), at + head, stop
        at = stop


def _find(b: bytes, box: tuple[int, int], *path: str) -> list[tuple[int, int]]:
    found = [box]
    for name in path:
        found = [(s, e) for x in found for n, s, e in _boxes(b, *x) if n == name]
    return found


def frame_times(b: bytes | None) -> dict | None:
    """Size, duration and frame times in seconds of the first video track of an MP4 file, also of a fragmented one."""
    if b is None or b[4:8] != b"ftyp":
        return None
    try:
        for moov in _find(b, (0, len(b)), "moov"):
            for trak in _find(b, moov, "trak"):
                if any(b[s + 8 : s + 12] == b"vide" for s, _ in _find(b, trak, "mdia", "hdlr")):
                    return _track(b, moov, trak)
    except (struct.error, IndexError):
        return None
    return None


def _track(b: bytes, moov: tuple[int, int], trak: tuple[int, int]) -> dict | None:
    u32 = lambda at: struct.unpack_from(">I", b, at)[0]
    (head, head_end), (media, _) = _find(b, trak, "tkhd")[0], _find(b, trak, "mdia", "mdhd")[0]
    track = u32(head + (20 if b[head] else 12))
    scale = u32(media + (20 if b[media] else 12)) or 1
    steps: list[tuple[int, int]] = []  # start, length
    now = 0
    for s, _ in _find(b, trak, "mdia", "minf", "stbl", "stts"):
        for i in range(u32(s + 4)):
            n, d = struct.unpack_from(">II", b, s + 8 + 8 * i)
            steps += [(now + k * d, d) for k in range(n)]
            now += n * d
    if not steps:
        usual = next((u32(s + 12) for s, _ in _find(b, moov, "mvex", "trex") if u32(s + 4) == track), 0)
        for traf in _find(b, (0, len(b)), "moof", "traf"):
            s = _find(b, traf, "tfhd")[0][0]
            if u32(s + 4) != track:
                continue
            flags = u32(s) & 0xFFFFFF
            each = u32(s + 8 + 8 * (flags & 1) + 4 * (flags >> 1 & 1)) if flags & 8 else usual
            for t, _ in _find(b, traf, "tfdt"):
                now = struct.unpack_from(">Q", b, t + 4)[0] if b[t] else u32(t + 4)
            for r, _ in _find(b, traf, "trun"):
                f = u32(r) & 0xFFFFFF
                at = r + 8 + 4 * (f & 1) + 4 * (f >> 2 & 1)
                width = 4 * sum(f >> k & 1 for k in (8, 9, 10, 11))
                for k in range(u32(r + 4)):
                    d = u32(at + k * width) if f & 0x100 else each
                    steps.append((now, d))
                    now += d
    if not steps:
        return None
    size = [round(u32(head_end - i) / 65536) for i in (8, 4)]
    return {"width": size[0], "height": size[1], "duration": now / scale, "frame_times": [round(s / scale, 3) for s, _ in steps]}


def _mapped(df: DataFrame, f, name: str, kind: str) -> DataFrame:
    @F.pandas_udf(kind)
    def read(content: pd.Series) -> pd.DataFrame:
        rows = [f(None if c is None else bytes(c)) for c in content]
        keys = [x.split(":")[0].strip() for x in _fields(kind)]
        return pd.DataFrame([r or dict.fromkeys(keys) for r in rows], columns=keys)

    return df.withColumn(name, read("content"))


def _fields(kind: str) -> list[str]:
    inner, depth, out, last = kind[7:-1], 0, [], 0
    for i, c in enumerate(inner):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(inner[last:i])
            last = i + 1
    return [*out, inner[last:]]


def images(df: DataFrame) -> DataFrame:
    """Add ``image`` to rows with ``content``."""
    return _mapped(df, image_blocks, "image", BLOCKS)


def videos(df: DataFrame) -> DataFrame:
    """Add ``video`` to rows with ``content``."""
    return _mapped(df, frame_times, "video", FRAMES)


def label_signals(df: DataFrame) -> DataFrame:
    """``path``, ``kind``, ``detail``: what the metadata says about how an image was made, each once.

    kinds: ``source_type``, ``generator``, ``generator_settings``, ``credentials``; of
    source types and tools the first in the lists above counts for a block.
    """
    b = df.select("path", F.explode("image.blocks").alias("b"))
    text = F.decode("b.body", "ISO-8859-1")
    key = F.regexp_extract(text, "^([^\\x00]+)\\x00", 1)
    kind = F.col("b.kind")

    def first(words: tuple[str, ...]) -> Column:
        return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words])

    manifest = (kind == "app11") & text.rlike("jumb|c2pa") | kind.isin("caBX", "C2PA")
    signal = lambda name, detail: F.when(detail.isNotNull(), F.struct(F.lit(name).alias("kind"), detail.alias("detail")))
    signals = F.array_compact(F.array(
        signal("credentials", F.when(manifest, F.lit("c2pa"))), signal("source_type", first(SOURCE_TYPES)), signal("generator", first(GENERATORS)),
        signal("generator_settings", F.when(kind.isin("tEXt", "iTXt", "zTXt") & key.isin(*GENERATOR_KEYS), key)),
    ))
    return b.select("path", F.explode(signals).alias("s")).select("path", "s.kind", "s.detail").distinct()


def labels(df: DataFrame) -> DataFrame:
    """``path``, ``ai_label``, ``credentials`` of every image: whether its file says it was made with a model, and whether it carries a manifest."""
    s = label_signals(df).groupBy("path").agg(F.bool_or(F.col("kind") != "credentials").alias("a"), F.bool_or(F.col("kind") == "credentials").alias("c"))
    return df.select("path").join(s, "path", "left").select("path", F.coalesce("a", F.lit(False)).alias("ai_label"), F.coalesce("c", F.lit(False)).alias("credentials"))


def verdict(ai_label: Column, model: Column, confidence: Column, least: float = 0.6) -> Column:
    """A label in the file beats the model; a weak finding can't tell; no answer is unavailable."""
    said = F.when(model == "likely_authentic", "no_ai_signs").when(model.isin(*VERDICTS), model).otherwise("cant_tell")
    return F.when(ai_label, "labelled_ai").when(model.isNull(), "unavailable").when((said == "likely_ai") & (confidence < least), "cant_tell").otherwise(said)


def clean_box(b: Column) -> Column:
    """Left, top, right, bottom on the grid; null if not four numbers or inside out."""
    c = F.transform(b, lambda x: F.greatest(F.lit(0), F.least(F.lit(GRID), F.floor(x + 0.5))))
    ok = (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull() | F.isnan(x.cast("double")))
    c = F.when(ok, c)
    return F.when((c[2] > c[0]) & (c[3] > c[1]), c)


def union_box(a: Column, b: Column) -> Column:
    """The box around two; the other where one is null."""
    both = F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def hide_box(b: Column) -> Column:
    """A box grown by a quarter of its width (20 at least) and 15 % of its height (15 at least), within the grid."""
    dx = F.greatest(F.lit(20), F.floor((b[2] - b[0]) * 0.25 + 0.5))
    dy = F.greatest(F.lit(15), F.floor((b[3] - b[1]) * 0.15 + 0.5))
    zero, top = F.lit(0).cast("bigint"), F.lit(GRID).cast("bigint")
    return F.when(b.isNotNull(), F.array(F.greatest(zero, b[0] - dx), F.greatest(zero, b[1] - dy), F.least(top, b[2] + dx), F.least(top, b[3] + dy)))


def visible_regions(regions: Column, harmful: Column) -> Column:
    """Regions that are hidden: private details always, the others where the image is harmful; names once each."""
    shown = F.filter(regions, lambda r: F.coalesce(r["privacy"], F.lit(False)) | harmful)
    return F.array_sort(F.array_distinct(F.transform(shown, lambda r: r["what"])))


def tracked(boxes: DataFrame, frame: str, box: str) -> DataFrame:
    """The box around all boxes of a frame."""
    side = lambda i, f: f(F.col(box)[i])
    return boxes.filter(F.col(box).isNotNull()).groupBy(frame).agg(F.array(side(0, F.min), side(1, F.min), side(2, F.max), side(3, F.max)).alias(box))


def clean_assessment(signs: Column, most: int = 4) -> Column:
    """Signs with a reason, in order: at most ``most`` said ones are looked at, texts trimmed and cut, boxes checked."""
    said = F.filter(F.slice(signs, 1, most), lambda s: F.coalesce(F.trim(s["why"]) != "", F.lit(False)))
    return F.transform(said, lambda s: F.struct(F.left(F.trim(s["what"]), F.lit(60)).alias("what"), F.trim(s["why"]).alias("why"), clean_box(s["box"]).alias("box")))
