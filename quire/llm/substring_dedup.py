"""Substring dedup by suffix automata and matching statistics.

A window of `window` words goes if the same words also start earlier. Windows meet through anchors: a window's anchor is
its word 8-gram of least hash, so equal windows have equal anchors, and consecutive windows mostly share one. Anchors that
occur once can't be in a repeated window; one pass counts them and a bitmap of fixed size marks the others (a false mark
costs time, not truth). A second pass sends, for each marked anchor, its context: the words of the windows it anchors.

The contexts of an anchor are a reference shard. They stream in document order past the shard's suffix automaton, which
holds the contexts before; matching statistics of `window` words or more are the windows seen earlier, on the words
themselves. What is new is added. Anchors with HEAVY occurrences or more would make shards without bound: there, equal
contexts are first reduced to their first one by salted sums, and the windows of what is left are compared as text, again
by salted sums. Both ways are exact; no shard holds more than HEAVY contexts.

Shards are shuffled to tasks, not broadcast: a broadcast of all automata would grow with the corpus.

Defined results: null or empty text has no words; a null doc_id is smaller than all others; doc_id must be a whole number, window 2 to LONGEST words; rows that share a doc_id
and a text have equal starts, so neither is earlier; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_texts, mix64, open_folder, require_whole, slices, staged, staged_path, with_group

#: Words of an anchor, or fewer in short windows.
GRAM = 8
#: Longest window: a context's windows are bits of a 64-bit mask.
LONGEST = 60
#: Bits of the bitmap of repeated anchors; 2 ** 26 are 8 MB in each Python worker.
BITS = 26
CHUNK = 19
HEAVY = 512


def gram_of(window: int) -> int:
    """Words of an anchor: a third of the window at least, so that neighbouring windows share anchors."""
    if not 2 <= window <= LONGEST:
        raise ValueError(f"window must be 2 to {LONGEST} words, not {window}")
    return min(GRAM, max(1, window // 2))


def word_hashes(split: list[list[bytes]]) -> np.ndarray:
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in itertools.chain.from_iterable(split)), np.int64, sum(map(len, split)))
    return np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[ids] if known else np.zeros(0, np.uint64)


def anchors_of(split: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, anchor's place, anchor's hash) of every window, places counted over all texts' words."""
    counts = np.fromiter(map(len, split), np.int64, len(split))
    word = word_hashes(split)
    n = len(word)
    none = np.zeros(0, np.int64)
    if n < window:
        return none, none, none, none
    size = gram_of(window)
    m = n - size + 1
    gram = np.zeros(m, np.uint64)
    for k in range(size):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + word[k : m + k]
    gram = mix64(gram)
    # the leftmost least gram of each window, by doubling
    value, place, span, need = gram, np.arange(m), 1, window - size + 1
    while span < need:
        step = min(span, need - span)
        a, b = value[: len(value) - step], value[step:]
        right = b < a
        value, place = np.where(right, b, a), np.where(right, place[step:], place[: len(place) - step])
        span += step
    text = np.repeat(np.arange(len(split)), counts)
    start = np.arange(n - window + 1)
    inside = text[start] == text[start + window - 1]
    start, place = start[inside], place[start[inside]]
    return text[start], start, place, gram[place].view(np.int64)


def anchor_counts(docs: DataFrame, window: int) -> DataFrame:
    """anchor, n: the occurrences of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                _, _, place, h = anchors_of([t.split() for t in byte_texts(part.column("text"))], window)
                _, first = np.unique(place, return_index=True)
                keys, n = np.unique(h[first], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def mark_repeated(counts: DataFrame) -> str:
    """Writes the bitmaps of anchors that occur twice, and HEAVY times; their folder. Their size is fixed."""
    rows = counts.where("n > 1").select(F.col("anchor").bitwiseAND(F.lit((1 << BITS) - 1)).alias("bit"), (F.col("n") >= HEAVY).alias("heavy"))
    rows = rows.withColumn("chunk", F.shiftright("bit", CHUNK).cast("int")).repartition("chunk").sortWithinPartitions("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, bits, heavy = None, None, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(bits).tobytes()]), pa.array([np.packbits(heavy).tobytes()])], names=["chunk", "bits", "heavy"])

        for batch in batches:
            chunks, at, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "bit", "heavy"))
            for c in np.unique(chunks):
                if c != chunk:
                    if chunk is not None:
                        yield out()
                    chunk, bits, heavy = int(c), np.zeros(1 << CHUNK, bool), np.zeros(1 << CHUNK, bool)
                mine = chunks == c
                low = at[mine] & ((1 << CHUNK) - 1)
                bits[low] = True
                heavy[low[h[mine].astype(bool)]] = True
        if chunk is not None:
            yield out()

    folder = staged_path(counts.sparkSession, "substring-marks")
    rows.mapInArrow(run, "chunk int, bits binary, heavy binary").write.parquet(folder)
    return folder


@lru_cache(maxsize=1)
def marks(folder: str) -> tuple[np.ndarray, np.ndarray]:
    files, base = open_folder(folder)
    out = np.zeros((1 << BITS) // 8, np.uint8), np.zeros((1 << BITS) // 8, np.uint8)
    size = (1 << CHUNK) // 8
    for info in files.get_file_info(pa.fs.FileSelector(base)):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                for row in pq.read_table(f, use_threads=False).to_pylist():
                    for k, name in enumerate(("bits", "heavy")):
                        out[k][row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row[name], np.uint8)
    return out


def marked(bitmap: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    bit = anchors & ((1 << BITS) - 1)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


def contexts(docs: DataFrame, folder: str, window: int) -> DataFrame:
    """doc_id, row (hash of the text), start, n (windows), anchor, heavy, digest (of heavy ones) and words of each marked anchor's context."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated, heavy = marks(folder)
        for batch in batches:
            for part in slices(batch, "text"):
                split = [t.split() for t in byte_texts(part.column("text"))]
                text, start, place, h = anchors_of(split, window)
                keep = marked(repeated, h)
                text, start, place, h = text[keep], start[keep], place[keep], h[keep]
                change = np.flatnonzero((place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])) + 1
                begin = np.concatenate([[0], change]).astype(np.int64) if len(text) else np.zeros(0, np.int64)
                n = np.diff(np.concatenate([begin, [len(text)]]))
                which, first = text[begin], start[begin]
                offset = np.cumsum([0, *map(len, split)])[which]
                own = first - offset
                words = [b" ".join(split[t][a : a + k + window - 1]) for t, a, k in zip(which.tolist(), own.tolist(), n.tolist(), strict=True)]
                much = marked(heavy, h[begin])
                digests = [hashlib.blake2b(w, digest_size=16).digest() if m else None for w, m in zip(words, much.tolist(), strict=True)]
                ids, rows = part.column("doc_id").take(pa.array(which)), part.column("row").take(pa.array(which))
                yield pa.RecordBatch.from_arrays(
                    [ids, rows, pa.array(own, pa.int64()), pa.array(n, pa.int32()), pa.array(h[begin]), pa.array(much), pa.array(digests, pa.binary()), pa.array(words, pa.binary())],
                    names=["doc_id", "row", "start", "n", "anchor", "heavy", "digest", "words"],
                )

    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, row long, start long, n int, anchor long, heavy boolean, digest binary, words binary")


class SuffixAutomaton:
    """All substrings of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def add(self, sequence: list) -> None:
        last = 0
        for w in sequence:
            last = self._extend(last, w)

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves), self.link.append(link), self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, w) -> int:
        """The state of p's strings followed by w, apart from q's longer ones."""
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w) -> int:
        q = self.next[last].get(w)
        if q is not None:  # the sequence so far is a known substring
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, w)
        new = self._state(self.length[last] + 1, {}, 0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, w)
        return new

    def matching(self, sequence: list) -> Iterator[int]:
        """At each place, the length of the longest known substring that ends there."""
        state, length = 0, 0
        for w in sequence:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                state = length = 0
            else:
                state, length = to, length + 1
            yield length


def shard_repeats(rows: list[tuple], window: int) -> list[int]:
    """rows (doc_id, row, start, n, words) of one anchor in document order; for each, the bits of its windows seen earlier."""
    out = []
    if len({r[4] for r in rows}) == 1:  # one context: all but the first go
        first = rows[0][:3:2]
        return [0 if r[:3:2] == first else (1 << r[3]) - 1 for r in rows]
    automaton, seen, waiting, at = SuffixAutomaton(), set(), [], None
    for r in rows:
        if (r[0], r[2]) != at:  # rows of one place don't see each other
            for w in waiting:
                automaton.add(w)
            waiting, at = [], (r[0], r[2])
        if r[4] in seen and not any(r[4] == b" ".join(w) for w in waiting):
            out.append((1 << r[3]) - 1)
            continue
        words = r[4].split(b" ")
        mask = 0
        for i, length in enumerate(automaton.matching(words)):
            if length >= window:
                mask |= 1 << (i - window + 1)
        out.append(mask)
        if mask != (1 << r[3]) - 1:
            waiting.append(words)
            seen.add(r[4])
    return out


def light_repeats(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, row, start, mask of contexts with windows that start earlier; a shard is one anchor's rows."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}[kind]
    dealt = rows.select("anchor", "doc_id", "row", "start", "n", "words").repartition("anchor").sortWithinPartitions("anchor", F.col("doc_id").asc_nulls_first(), "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            anchor, group = None, []
            for batch in batches:
                for part in (batch.slice(k, 2048) for k in range(0, batch.num_rows, 2048)):
                    for r in zip(*(part.column(c).to_pylist() for c in ("anchor", "doc_id", "row", "start", "n", "words")), strict=True):
                        if r[0] != anchor and group:
                            yield group
                            group = []
                        anchor = r[0]
                        group.append(r[1:])
            if group:
                yield group

        found: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((id_type, pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "row", "start", "mask"])

        for group in groups():
            if len(group) > 1:
                found += [(*r[:3], m) for r, m in zip(group, shard_repeats(group, window), strict=True) if m]
            if len(found) > 20_000:
                yield out()
                found.clear()
        yield out()

    return dealt.mapInArrow(run, f"doc_id {kind}, row long, start long, mask long")


def heavy_repeats(rows: DataFrame, window: int) -> DataFrame:
    """The same for anchors without bound, by salted sums: first equal contexts, then equal windows of the first ones."""
    place = F.struct(F.col("doc_id").alias("doc"), F.col("start").alias("at"))
    grouped = with_group(rows.select("doc_id", "row", "start", "n", "digest", "words"), ["digest"], ["doc_id", "start"], place)
    first = F.col("doc_id").eqNullSafe(F.col("least.doc")) & (F.col("start") == F.col("least.at"))
    grouped = staged(grouped.withColumn("first", first).withColumn("words", F.when(first, F.col("words"))).drop("least", "size"), "substring-heavy")
    later = grouped.where("NOT first").select("doc_id", "row", "start", F.expr("shiftleft(1L, n) - 1").alias("mask"))
    word = F.split(F.decode("words", "utf-8"), " ")
    windows = grouped.where("first").select("doc_id", "row", "start", word.alias("words"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    windows = windows.select("doc_id", "row", "start", "k", F.concat_ws(" ", F.slice("words", F.col("k") + 1, window)).alias("text"), (F.col("start") + F.col("k")).alias("begin"))
    met = with_group(windows, ["text"], ["doc_id", "begin"], F.struct(F.col("doc_id").alias("doc"), F.col("begin").alias("at")))
    earlier = met.where(~(F.col("doc_id").eqNullSafe(F.col("least.doc")) & (F.col("begin") == F.col("least.at"))))
    some = earlier.groupBy("doc_id", "row", "start").agg(F.expr("bit_or(shiftleft(1L, k))").alias("mask"))
    return later.unionByName(some)


def substring_dedup(docs: DataFrame, window: int = 20, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text if asked for): one row per row of docs."""
    gram_of(window)
    require_whole(docs, "doc_id")
    marks_in = mark_repeated(anchor_counts(docs, window))
    found = staged(contexts(docs, marks_in, window), "substring-contexts")
    removed = light_repeats(found.where("NOT heavy"), window).unionByName(heavy_repeats(found.where("heavy"), window))
    lists = removed.groupBy("doc_id", "row").agg(F.collect_list("start").alias("starts"), F.collect_list("mask").alias("masks"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    joined = rows.alias("d").join(lists.alias("l"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("d.row") == F.col("l.row")), "left").select("d.doc_id", "d.text", "l.starts", "l.masks")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, gone, sha, texts = [], [], [], []
                for text, starts, masks in zip(byte_texts(part.column("text")), part.column("starts").to_pylist(), part.column("masks").to_pylist(), strict=True):
                    words = text.split()
                    n.append(len(words))
                    if starts:
                        edge = np.zeros(len(words) + 1, np.int64)
                        s, m = np.array(starts), np.array(masks)
                        for k in range(int(m.max()).bit_length()):
                            at = s[(m >> k) & 1 == 1] + k
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + window, -1)
                        left = np.cumsum(edge[:-1]) == 0
                        words = list(itertools.compress(words, left.tolist()))
                    gone.append(n[-1] - len(words))
                    kept = b" ".join(words)
                    sha.append(hashlib.sha256(kept).hexdigest())
                    if with_text:
                        texts.append(kept.decode("utf-8", "replace"))
                columns, names = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(texts, pa.string())), names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
