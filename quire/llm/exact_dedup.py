"""Exact dedup by content-defined chunk recipes.

Texts, normalised by deleting ASCII white space, are cut where a rolling hash of the last 16 bytes says so; equal
stretches of text are thus cut alike. A chunk's identifier is its fingerprint, verified over the whole corpus:
distinct chunk contents are gathered once (with map-side combine), and a fingerprint with two contents gets an
ordinal for each. A text is then its recipe, the ordered list of verified identifiers, and equal recipes mean
equal texts; a long document's bytes move once, for verification, whatever the number of later steps.

Defined results: null counts as empty, and all empty texts form one group; rows that share a doc_id are rows like any
other (of equal texts, the least doc_id of the longest stays; its repeated rows all have kept = true); a null doc_id
sorts before all others; further columns are ignored, or returned by `keep_documents`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import WHITESPACE, byte_texts, likely, mix64, slices, staged, with_group

SPAN = 16
MEAN = 4096
LEAST = 512
MOST = 65536


def fingerprint(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def cuts(text: bytes, mean: int = MEAN, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of text. A cut falls after 16 bytes whose hash is 0 modulo mean, at least `least` and at most `most` bytes after the last."""
    n = len(text)
    if n <= least:
        return [n]
    b = np.frombuffer(text, np.uint8).astype(np.uint64)
    h = np.zeros(n - SPAN + 1, np.uint64)
    for k in range(SPAN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + b[k : n - SPAN + 1 + k]
    wanted = np.flatnonzero(mix64(h) % np.uint64(mean) == 0) + SPAN
    out, last = [], 0
    for at in wanted.tolist():
        while at - last > most:
            last += most
            out.append(last)
        if at - last >= least and at < n:
            out.append(at)
            last = at
    while n - last > most:
        last += most
        out.append(last)
    return [*out, n]


def chunks_of(text: bytes) -> list[bytes]:
    start, out = 0, []
    for end in cuts(text):
        out.append(text[start:end])
        start = end
    return out


def _normalised(part: pa.RecordBatch) -> Iterator[tuple[bytes, bytes]]:
    for raw in byte_texts(part.column("text")):
        yield raw, raw.translate(None, WHITESPACE)


def recipes(docs: DataFrame, mark: Callable[[bytes], bytes] = fingerprint) -> DataFrame:
    """doc_id, n_points (code points of the original text), raw_sha256 (of the text as it is), text_sha256 (normalised),
    recipe (fingerprints in order) for every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                points, whole, sha, recipe = [], [], [], []
                for raw, text in _normalised(part):
                    points.append(len(raw.decode("utf-8", "replace")))
                    whole.append(hashlib.sha256(raw).hexdigest())
                    sha.append(hashlib.sha256(text).hexdigest())
                    recipe.append([mark(c) for c in chunks_of(text)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(points, pa.int64()), pa.array(whole, pa.string()), pa.array(sha, pa.string()), pa.array(recipe, pa.list_(pa.binary()))], names=["doc_id", "n_points", "raw_sha256", "text_sha256", "recipe"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_points long, raw_sha256 string, text_sha256 string, recipe array<binary>")


def chunk_contents(docs: DataFrame, mark: Callable[[bytes], bytes] = fingerprint) -> DataFrame:
    """mark, content of the chunks of all texts, once for each run of rows that holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 23):
                found = {c for _, text in _normalised(part) for c in chunks_of(text)}
                yield pa.RecordBatch.from_arrays([pa.array([mark(c) for c in found], pa.binary()), pa.array(list(found), pa.binary())], names=["mark", "content"])

    return docs.select("text").mapInArrow(run, "mark binary, content binary")


def verified(docs: DataFrame, found: DataFrame, mark: Callable[[bytes], bytes] = fingerprint) -> DataFrame:
    """found with its recipes' identifiers made exact.

    All contents behind one fingerprint are compared; where they are one, the fingerprint is the identifier. Else
    the texts' recipes are rebuilt from (fingerprint, ordinal of the content).
    """
    distinct = chunk_contents(docs, mark).distinct()
    clashes = distinct.groupBy("mark").count().where("count > 1")
    clashes = staged(clashes.select("mark"), "chunk-clashes")
    if clashes.isEmpty():
        return found
    ordinals = staged(
        distinct.join(clashes, "mark").groupBy("mark").agg(F.sort_array(F.collect_set("content")).alias("contents")).select("mark", F.posexplode("contents").alias("ordinal", "content")),
        "chunk-ordinals",
    )  # as many rows as contents that share a fingerprint: none, in practice

    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = [(d, hashlib.sha256(t).hexdigest(), i, mark(c), c) for d, (_, t) in zip(part.column("doc_id").to_pylist(), _normalised(part), strict=True) for i, c in enumerate(chunks_of(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((part.column("doc_id").type, pa.string(), pa.int32(), pa.binary(), pa.binary()))], names=["doc_id", "text_sha256", "at", "mark", "content"])

    placed = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_sha256 string, at int, mark binary, content binary")
    exact = placed.join(ordinals, ["mark", "content"]).groupBy("doc_id", "text_sha256").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("at", "ordinal")))).alias("exact"))
    joined = found.alias("f").join(exact.alias("e"), F.col("f.doc_id").eqNullSafe(F.col("e.doc_id")) & (F.col("f.text_sha256") == F.col("e.text_sha256")), "left")
    with_ordinal = "transform(recipe, (m, i) -> concat(m, coalesce(cast(cast(element_at(exact, i) as string) as binary), X'')))"
    return joined.select("f.doc_id", "f.n_points", "f.raw_sha256", "f.text_sha256", F.when(F.col("e.exact").isNull(), F.col("f.recipe")).otherwise(F.expr(with_ordinal)).alias("recipe"))


def judged(docs: DataFrame, mark: Callable[[bytes], bytes]) -> DataFrame:
    """doc_id, n_points, raw_sha256, text_sha256, keep_id, group_size, kept: one row per row of docs."""
    found = verified(docs, staged(recipes(docs, mark), "recipes"), mark)
    order = F.struct((-F.col("n_points")).alias("shorter"), F.col("doc_id").alias("id"))
    out = with_group(found, ["recipe"], ["doc_id"], order)
    return out.select("doc_id", "n_points", "raw_sha256", "text_sha256", F.col("least.id").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("least.id")).alias("kept"))


def exact_dedup(docs: DataFrame, mark: Callable[[bytes], bytes] = fingerprint) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs."""
    return judged(docs, mark).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with docs' own columns.

    Of kept rows that share a doc_id, the one with the most code points stays, then the one whose text has the least
    hash; of rows equal in all this, one. All of it is settled on slim rows. Rows that stay and have no twin are passed
    on where they are; only those to drop, and repeated rows, move, to be held against the verdicts exactly.
    """
    rows = staged(judged(docs, fingerprint).select("doc_id", "n_points", "raw_sha256", "text_sha256", "kept"), "exact-verdicts")
    best = F.min(F.struct((-F.col("n_points")).alias("shorter"), F.col("raw_sha256").alias("raw"))).alias("best")
    # a doc_id and text occurs once, but for repeated rows: these meet in partial sums before they are shuffled
    texts = rows.groupBy("doc_id", "text_sha256", "raw_sha256", "n_points", "kept").agg(F.count(F.lit(1)).alias("n"))
    ids = texts.where("kept").groupBy("doc_id", "text_sha256").agg(best, F.count(F.lit(1)).alias("versions")).where("versions > 1")
    t, i = texts.alias("t"), ids.alias("i")
    met = t.join(i, F.col("t.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("t.text_sha256") == F.col("i.text_sha256")), "left")
    stays = F.col("t.kept") & (F.col("i.best").isNull() | (F.col("i.best.raw") == F.col("t.raw_sha256")))
    open_rows = staged(met.select("t.doc_id", "t.raw_sha256", stays.alias("stays"), "t.n").where("NOT stays OR n > 1").select("doc_id", "raw_sha256", "stays"), "exact-open")
    key = ["doc_id", F.sha2(F.coalesce("text", F.lit("")), 256)]
    marks = open_rows.select("doc_id", "raw_sha256")
    sure = likely(docs, marks, key, negate=True)
    doubtful = likely(docs, marks, key).withColumn("_raw", key[1]).dropDuplicates(["doc_id", "_raw"])
    joined = doubtful.alias("r").join(open_rows.where("NOT stays").alias("o"), F.col("r.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("r._raw") == F.col("o.raw_sha256")), "left_anti")
    return sure.unionByName(joined.select(*[F.col(f"r.`{c}`") for c in docs.columns]))
