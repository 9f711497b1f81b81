"""Images as rows: header probes, kinds, duplicates. Pixels are never decoded, so nothing is rescaled here."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def probe(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, JPEG or WebP file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + size
    return None


def mime_type(content: str | Column = "content") -> Column:
    """By the first bytes; PNG if they tell nothing."""
    c = F.hex(F.substring(F.col(content) if isinstance(content, str) else content, 1, 4))
    return F.when(c.startswith("FFD8FF"), "image/jpeg").when(c.startswith("474946"), "image/gif").when(c == "52494646", "image/webp").otherwise("image/png")


def with_size(images: DataFrame, content: str = "content") -> DataFrame:
    """images with width and height (null if the header tells nothing)."""
    names = images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [probe(x or b"") or (None, None) for x in batch.column(content).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s[0] for s in sizes], pa.int32()), pa.array([s[1] for s in sizes], pa.int32())], names=[*names, "width", "height"])

    return images.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in images.dtypes) + ", width int, height int")


def large_enough(width: int = 100, height: int = 100) -> Column:
    return (F.col("width") >= width) & (F.col("height") >= height)


def distinct_images(images: DataFrame) -> DataFrame:
    """One row per document and content (doc_id, image_id, page, ordinal, content): the first record, the pages in order,
    and the ids of the repeats. Records of a document are few; contents aren't gathered, only their ids."""
    keyed = images.withColumn("sha1", F.sha1("content"))
    first = Window.partitionBy("doc_id", "sha1").orderBy("ordinal")
    lists = keyed.groupBy("doc_id", "sha1").agg(F.array_sort(F.collect_list(F.struct("ordinal", "image_id", "page"))).alias("_r"))
    pages = F.array_distinct(F.filter(F.transform("_r", lambda r: r["page"]), lambda p: p.isNotNull()))
    aliases = F.transform(F.slice("_r", 2, F.size("_r")), lambda r: r["image_id"])
    heads = keyed.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return heads.join(lists.select("doc_id", "sha1", pages.alias("pages"), aliases.alias("aliases")), ["doc_id", "sha1"])


def select(images: DataFrame, page: int | None = None, image_id: str | None = None, most: int | None = None) -> DataFrame:
    """Images of a page, by id or alias, or all distinct ones; at most `most` a document, in order."""
    if page is not None:
        out = images.where(F.col("page") == page)
    else:
        out = distinct_images(images)
        if image_id is not None:
            out = out.where((F.col("image_id") == image_id) | F.array_contains("aliases", image_id))
    if most is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal"))).where(F.col("_n") <= most).drop("_n")


def markers(text: str = "text") -> Column:
    """Ids of the image markers in a text."""
    return F.regexp_extract_all(text, F.lit(r"!\[[^\]\n]*\]\(image:([\w.-]+)\)"), F.lit(1))
