"""Quality classifier: an interpolated modified Kneser-Ney model over byte n-grams of trusted text.

Six bytes fit a 64-bit key exactly, so that counting, continuation counts and the interpolation are joins and
aggregations of slim rows, sharded by key; a context has at most 256 successors, so no key is hot. Every trusted
labelled row that isn't held out is counted, whole. Scoring merges the distinct n-grams of each run of documents (RUN bytes
of text) with the sorted shards of the finished model, one after the other; a worker keeps the first HELD rows of the model
from run to run and reads the other shards again. Documents are never shuffled to be scored: the README has the figures of
the join by (document, n-gram) that this stands in for.

A language's threshold is a quantile of the perplexities of its trusted rows that were held out from training; where a
language has none, that of all of them.

Defined results: null or empty text has no perplexity and isn't kept; a null lang is a language of its own; without
trusted rows nothing is rejected; rows are scored alone, so ties and repeated rows are alike; a null doc_id is scored
(and never trusted); further columns are ignored. A long text is scored in pieces that carry their context along.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_texts, free_arrow, likely, open_folder, slices, staged, staged_path

ORDER = 6
#: Bytes of text that are looked up in the model together, and that are keyed at once.
RUN = 4 << 20
PIECE = 1 << 20
#: Model rows of a shard, and those that a Python worker keeps from run to run; 13 bytes each.
SHARD = 250_000
HELD = 4_000_000


def keys_of(piece: np.ndarray) -> np.ndarray:
    """The n-gram key that ends at each byte from the ORDER-th on."""
    n = len(piece) - ORDER + 1
    key = np.zeros(max(0, n), np.int64)
    for j in range(ORDER if n > 0 else 0):
        key = (key << 8) | piece[j : j + n]
    return key


def pieces_of(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """(row, number of its bytes, ...) and all keys, for pieces of about PIECE bytes; a long text is cut, its context kept."""
    rows, sizes, keys, total = [], [], [], 0
    for i, t in enumerate(texts):
        padded = b"\0" * (ORDER - 1) + t
        for start in range(0, len(t), PIECE):
            piece = np.frombuffer(padded[start : start + PIECE + ORDER - 1], np.uint8).astype(np.int64)
            rows.append(i), sizes.append(len(piece) - ORDER + 1), keys.append(keys_of(piece))
            total += sizes[-1]
            if total >= PIECE:
                yield rows, sizes, np.concatenate(keys)
                rows, sizes, keys, total = [], [], [], 0
    if rows:
        yield rows, sizes, np.concatenate(keys)


def gram_counts(docs: DataFrame) -> DataFrame:
    """key, c: the n-grams of all texts; summed within a task before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out():
            for start in range(0, len(keys), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(keys[start : start + (1 << 17)]), pa.array(times[start : start + (1 << 17)])], names=["key", "n"])

        for batch in batches:
            for part in slices(batch, "text", PIECE):
                for _, _, found in pieces_of(byte_texts(part.column("text"))):
                    k, n = np.unique(found, return_counts=True)
                    both = np.concatenate([keys, k])
                    keys, inverse = np.unique(both, return_inverse=True)
                    times = np.bincount(inverse, np.concatenate([times, n]), len(keys)).astype(np.int64)
                    if len(keys) > 1_000_000:
                        yield from out()
                        keys, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
            free_arrow()
        yield from out()

    return docs.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("c"))


def discounts(level: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from the counts of counts."""
    n = {r["c"]: r["count"] for r in level.where("c <= 4").groupBy("c").count().collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return [0.5, 0.75, 0.75]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2]
    return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]


def train(docs: DataFrame) -> str | None:
    """Counts docs' texts and writes the model; its folder, or None without text.

    Model rows: level 1..ORDER with key -> log probability of the n-gram's last byte, and level 16 + k with
    context -> log of the weight that the context gives to the next lower order.
    """
    spark = docs.sparkSession
    levels = {ORDER: staged(gram_counts(docs), "lm-counts")}
    if levels[ORDER].isEmpty():
        return None
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("key").bitwiseAND(F.lit((1 << 8 * k) - 1))
        levels[k] = staged(levels[k + 1].groupBy(suffix.alias("key")).agg(F.count(F.lit(1)).alias("c")), "lm-counts")
    parts, below = [], None
    for k in range(1, ORDER + 1):
        d = discounts(levels[k])
        context = F.shiftright("key", 8).alias("h")
        some = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
        left = (F.lit(d[0]) * some(F.col("c") == 1) + F.lit(d[1]) * some(F.col("c") == 2) + F.lit(d[2]) * some(F.col("c") > 2)) / F.sum("c")
        contexts = staged(levels[k].groupBy(context).agg(F.sum("c").alias("total"), left.alias("gamma")), "lm-contexts")
        own = F.greatest(F.col("c") - F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2]), F.lit(0.0)) / F.col("total")
        seen = levels[k].withColumn("h", F.shiftright("key", 8)).join(contexts, "h")
        if below is None:
            p = seen.select("key", (own + F.col("gamma") / 256).alias("p"))
        else:
            lower = below.select(F.col("key").alias("suffix"), F.col("p").alias("p_lower"))
            seen = seen.withColumn("suffix", F.col("key").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)))
            p = seen.join(lower, "suffix").select("key", (own + F.col("gamma") * F.col("p_lower")).alias("p"))
        below = staged(p, "lm-level")
        parts += [below.select(F.lit(k).alias("level"), "key", F.log("p").alias("value")), contexts.select(F.lit(16 + k).alias("level"), F.col("h").alias("key"), F.log("gamma").alias("value"))]
    model = parts[0]
    for part in parts[1:]:
        model = model.unionByName(part)
    folder = staged_path(spark, "lm-model")
    shards = -(-sum(part.count() for part in parts) // SHARD)
    model.select(F.col("level").cast("int"), "key", F.col("value").cast("float")).repartitionByRange(shards, "level", "key").sortWithinPartitions("level", "key").write.parquet(folder)
    return folder


class Shards:
    """Look-ups of sorted keys in the model's sorted shards."""

    def __init__(self, folder: str, held: int = HELD):
        self.files, base = open_folder(folder)
        self.paths = sorted(i.path for i in self.files.get_file_info(pa.fs.FileSelector(base)) if i.path.endswith(".parquet"))
        self.room, self.held = held, []

    def shards(self) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
        """All shards in order: from memory as far as they are held, then from their files."""
        yield from self.held
        for path in self.paths[len(self.held) :]:
            shard = self._load(path)
            rows = sum(len(keys) for _, keys, _ in shard)
            if self.room >= rows:
                self.room -= rows
                self.held.append(shard)
            else:
                self.room = 0  # what is held is a prefix of the shards
            yield shard

    def _load(self, path: str) -> list[tuple[int, np.ndarray, np.ndarray]]:
        with self.files.open_input_file(path) as f:
            t = pq.read_table(f, use_threads=False)
        level, key, value = (t.column(c).to_numpy() for c in ("level", "key", "value"))
        cuts = [0, *(np.flatnonzero(level[1:] != level[:-1]) + 1).tolist(), len(level)]
        return [(int(level[a]), key[a:b], value[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def find(self, wanted: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
        """For each level's sorted keys, their values; NaN where the model has none. Each shard is visited once."""
        out = {level: np.full(len(q), np.nan) for level, q in wanted.items()}
        for shard in self.shards():
            for level, keys, values in shard:
                q = wanted.get(level)
                if q is None:
                    continue
                a, b = np.searchsorted(q, keys[0]), np.searchsorted(q, keys[-1], "right")
                if a == b:
                    continue
                at = np.searchsorted(keys, q[a:b])
                at[at == len(keys)] = 0
                hit = keys[at] == q[a:b]
                out[level][a:b][hit] = values[at[hit]]
        return out


@lru_cache(maxsize=1)
def shards(folder: str, held: int) -> Shards:
    return Shards(folder, held)


def log_probabilities(model: Shards, keys: np.ndarray) -> np.ndarray:
    """The interpolated log probability of each distinct (sorted) n-gram's last byte given the others."""
    out = model.find({ORDER: keys})[ORDER]
    missing = np.flatnonzero(np.isnan(out))
    if not len(missing):
        return out
    rest = keys[missing]
    asked, where = {}, {}
    for k in range(1, ORDER + 1):
        own = rest & ((1 << 8 * k) - 1)
        asked[16 + k], where[16 + k] = np.unique(own >> 8, return_inverse=True)
        if k < ORDER:
            asked[k], where[k] = np.unique(own, return_inverse=True)
    got = model.find(asked)
    total = np.full(len(rest), -np.log(256))  # of order 0
    for k in range(1, ORDER + 1):
        weight = got[16 + k][where[16 + k]]
        total += np.where(np.isnan(weight), 0.0, weight)
        if k < ORDER:
            p = got[k][where[k]]
            total = np.where(np.isnan(p), total, p)
    out[missing] = total
    return out


def score(docs: DataFrame, folder: str) -> DataFrame:
    """docs' doc_id and lang, n_bytes and perplexity of every row."""
    types = dict(docs.dtypes)
    held, bytes_of_run = HELD, RUN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shards(folder, held)
        for batch in batches:
            for part in slices(batch, "text", bytes_of_run):
                texts = byte_texts(part.column("text"))
                total = np.zeros(len(texts))
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                pieces, distinct = [], np.zeros(0, np.int64)
                for rows, sizes, keys in pieces_of(texts):
                    own, place = np.unique(keys, return_inverse=True)
                    pieces.append((rows, sizes, own, place.astype(np.int32)))
                    distinct = np.union1d(distinct, own)
                logs = log_probabilities(model, distinct)
                for rows, sizes, own, place in pieces:
                    ends = np.cumsum(sizes)
                    np.add.at(total, rows, np.add.reduceat(logs[np.searchsorted(distinct, own)][place], ends - sizes))
                with np.errstate(divide="ignore", invalid="ignore"):
                    perplexity = np.exp(-total / size)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(size), pa.array(perplexity, mask=size == 0)], names=["doc_id", "lang", "n_bytes", "perplexity"])
            free_arrow()

    return docs.select("doc_id", "lang", "text").mapInArrow(run, f"doc_id {types['doc_id']}, lang {types['lang']}, n_bytes long, perplexity double")


def calibration() -> Column:
    """Trusted rows kept from training, for the thresholds."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def quality_by_perplexity(docs: DataFrame, labels: DataFrame, quantile: float = 0.995) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold, kept: one row per row of docs."""
    trusted = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    taught = staged(trusted.where(~calibration()), "lm-taught")
    folder = train(likely(docs.select("doc_id", "text"), taught, ["doc_id"]).join(taught, "doc_id", "left_semi"))
    if folder is None:
        return docs.select("doc_id", "lang", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold")).withColumn("kept", F.col("n_bytes") > 0)
    scored = staged(score(docs, folder), "lm-scores")
    held = scored.join(trusted.where(calibration()), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    at = lambda name: F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000)).alias(name)
    by_lang = staged(held.groupBy("lang").agg(at("threshold")), "lm-thresholds")
    overall = held.agg(at("t")).collect()[0]["t"]
    out = scored.alias("s").join(by_lang.alias("t"), F.col("s.lang").eqNullSafe(F.col("t.lang")), "left")
    out = out.select("s.doc_id", "s.lang", "s.n_bytes", "s.perplexity", F.coalesce("t.threshold", F.lit(overall).cast("double")).alias("threshold"))
    return out.withColumn("kept", F.coalesce((F.col("perplexity") <= F.col("threshold")) | (F.col("threshold").isNull() & F.col("perplexity").isNotNull()), F.lit(False)))
