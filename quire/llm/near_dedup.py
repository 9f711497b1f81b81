"""MinHash near-dedup with tensored banding.

Two small collections of `m` hashes, each of two minhashes, are computed for a text's set of word shingles. The table
keys are all m * m pairs of a hash from the one and a hash from the other: as many tables as banding with 4 minhashes a
band would need, from about the square root of the minhashes. Texts with equal sets are one vertex.

Candidates are verified on full sets. First every vertex against one vertex of each of its buckets; large buckets that
still hold several components go through ROUNDS more, with another one each time. Then, in buckets that still do, the vertices with a
partner in another component that sizes and minhashes allow (and that no earlier table has brought together) are
compared, block by block: a matrix product over the shared shingles of a block gives all intersections, and only the
edges that join its rows leave the task. Pairs inside a component can't change it, and no pair of a bucket becomes a row.

What is exact, and what is nearly so: a link is only made on whole sets, whose shingles stand as 64-bit hashes (two of
n shingles collide with odds of n * n / 2 ** 65). A link can be missed: the tables miss a pair just at the similarity
with a probability below MISS, from which m follows, and a pair that they find is passed over if its minhashes agree
less than a pair at the similarity does but with a probability of 1e-6. Pairs above the similarity are missed less.

Defined results: null or empty text has an empty set, is linked with nothing and is kept; with fewer words than a
shingle the whole sequence is the one shingle; a null doc_id is linked with nothing; doc_id must be a whole number; rows that
share a doc_id are one vertex with all their texts, and say the same component (a row without words stands alone if all
rows of its doc_id have none); further columns are ignored, or returned by `keep_documents`.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bits_for, byte_texts, free, in_bitmap, likely, mix64, read_bitmap, require_whole, salt, slices, staged, with_group, write_bitmap

MISS = 1e-4
#: Rows of a block; a bucket is compared block by block.
BLOCK = 1000
#: Rounds, after the first, of comparing all of a bucket of more than LARGE rows with one of its rows; what is left is
#: compared in blocks, as smaller buckets are at once.
ROUNDS = 1
LARGE = 1000
#: Tasks that may share one such row.
SALTS = 64


def tables(similarity: float) -> int:
    """The size m of each collection: 2 * (1 - s**2) ** m <= MISS."""
    m = 1
    while 2 * (1 - similarity**2) ** m > MISS:
        m += 1
    return m


def least_shared(similarity: float, n: int) -> int:
    """Of n minhashes, how many a pair at `similarity` shares but with probability 1e-6."""
    total = 0.0
    for k in range(n + 1):
        total += comb(n, k) * similarity**k * (1 - similarity) ** (n - k)
        if total > 1e-6:
            return k
    return n


def shingle_sets(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text, A-Z lowered."""
    split = [t.lower().split() for t in texts]
    known: dict[bytes, int] = {}
    counts = list(map(len, split))
    ids = np.fromiter((known.setdefault(w, len(known)) for w in itertools.chain.from_iterable(split)), np.int64, sum(counts))
    word = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))[ids] if known else np.zeros(0, np.uint64)
    n = len(word)
    whole = np.zeros(max(0, n - words + 1), np.uint64)
    for k in range(words):
        whole = whole * np.uint64(0x9E3779B97F4A7C15) + word[k : n - words + 1 + k] if n >= words else whole
    whole = mix64(whole)
    out, at = [], 0
    for c in counts:
        if c >= words:
            out.append(np.unique(whole[at : at + c - words + 1]))
        elif c:
            h = xxhash.xxh64_intdigest(b" ".join(split[len(out)]), seed=c)
            out.append(np.array([h], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def _constants(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_001)
    return rng.integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def minhashes(found: np.ndarray, n: int) -> np.ndarray:
    odd, xor = _constants(n)
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 4096):
        part = found[start : start + 4096, None] ^ xor[None, :]
        part *= odd[None, :]
        part ^= part >> np.uint64(29)
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, collections a and b, sig (16 bits of each minhash): one pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    m = tables(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, digests, a, b, sigs = [], [], [], [], []
                for found in shingle_sets(byte_texts(part.column("text")), words):
                    n.append(len(found))
                    if not len(found):
                        digests.append(None), a.append(None), b.append(None), sigs.append(None)
                        continue
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    h = minhashes(found, 4 * m)
                    pairs = mix64(h[0::2] * np.uint64(0x9E3779B97F4A7C15) + h[1::2]).view(np.int64)
                    a.append(pairs[:m]), b.append(pairs[m:])
                    sigs.append((mix64(h) & np.uint64(0xFFFF)).astype("<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                    names=["doc_id", "n_shingles", "digest", "a", "b", "sig"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, digest binary, a array<long>, b array<long>, sig binary")


def bucket_keys(nodes: DataFrame, columns: list[str], only: DataFrame | None = None) -> DataFrame:
    """key, pos (the table) and columns of nodes: the tensor of the two collections, one row for each table.

    With `only` (a staged column of keys), rows whose key a bitmap rules out aren't made.
    """
    bits = bits_for(only.count()) if only is not None else 0
    folder = write_bitmap(only.toDF("key"), bits) if only is not None else None
    types = dict(nodes.dtypes)
    chosen = [c for c in columns if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = read_bitmap(folder, bits) if folder else None
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                a, b = (np.array(part.column(c).to_pylist(), np.int64).view(np.uint64) for c in ("a", "b"))
                n, m = a.shape
                table = np.arange(m * m, dtype=np.uint64).reshape(1, m, m)
                keys = mix64(a[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + b[:, None, :] * np.uint64(0xC2B2AE3D27D4EB4F) + table * np.uint64(0x165667B19E3779F9))
                keys = keys.reshape(-1).view(np.int64)
                keep = np.flatnonzero(in_bitmap(marks, keys)) if folder else np.arange(len(keys))
                row = pa.array(keep // (m * m))
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array((keep % (m * m)).astype(np.int32)), *(part.column(c).take(row) for c in columns)], names=["key", "pos", *columns])

    return nodes.select(*chosen, "a", "b").mapInArrow(run, "key long, pos int, " + ", ".join(f"{c} {types[c]}" for c in columns))


def shared(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), -1)


def plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v) that sizes and minhashes allow."""
    least = least_shared(similarity, 4 * tables(similarity))
    slim = nodes.select("node", "n_shingles", "sig")
    rows = pairs
    for k in ("u", "v"):
        rows = rows.join(slim.select(F.col("node").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sig").alias(f"sig_{k}")), k)
    rows = rows.where(F.least("n_u", "n_v") >= F.lit(similarity) * F.greatest("n_u", "n_v") - F.lit(1e-9)).select("u", "v", "sig_u", "sig_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                good = (shared(batch.column("sig_u").to_pylist()) == shared(batch.column("sig_v").to_pylist())).sum(1) >= least
                yield batch.select(["u", "v"]).filter(pa.array(good))

    return rows.mapInArrow(run, "u long, v long")


def verified(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union. Only their texts move.

    A text u meets its partners in up to SALTS tasks; it goes to each of them once, ahead of the partners dealt there.
    """
    salted = pairs.withColumn("salt", salt(["v"], SALTS))
    ends = pairs.select("u").union(pairs.select("v"))
    texts = staged(likely(docs.select(F.col("doc_id").alias("id"), "text"), ends, ["id"]), "near-texts")
    leads = salted.select("u", "salt").distinct().join(texts.select(F.col("id").alias("u"), "text"), "u").select("u", "salt", F.lit(None).cast("long").alias("v"), "text")
    partners = salted.join(texts.select(F.col("id").alias("v"), "text"), "v").select("u", "salt", "v", "text")
    rows = leads.union(partners).repartition("u", "salt").sortWithinPartitions("u", "salt", F.col("v").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, firsts = None, []
        for batch in batches:
            for part in slices(batch, "text"):
                us, vs, salts = (part.column(c).to_pylist() for c in ("u", "v", "salt"))
                good = []
                for u, v, s, mine in zip(us, vs, salts, shingle_sets(byte_texts(part.column("text")), words), strict=True):
                    if v is None:
                        firsts = [*firsts, mine] if at == (u, s) else [mine]
                        at = u, s
                    good.append(v is not None and any(enough(first, mine, percent) for first in firsts))
                yield part.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return rows.mapInArrow(run, "u long, v long").distinct()


def enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return union > 0 and 100 * both >= percent * union


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) of every node with a link: least labels of neighbours, then of one's label's label."""
    edges = staged(links.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(links.select("v", "u")), "near-edges")
    state = staged(edges.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("comp")), "near-labels")
    held = state
    while True:
        near = edges.join(state, edges.src == state.node).groupBy("dst").agg(F.min("comp").alias("near"))
        lower = state.join(near, state.node == near.dst, "left").select("node", F.least("comp", "near").alias("low"), F.col("comp").alias("was"))
        label = state.select(F.col("node").alias("low"), F.col("comp").alias("of_low"))
        new = staged(lower.join(label, "low", "left").select("node", F.least("low", "of_low").alias("comp"), "was"), "near-labels")
        free(held)
        held, state = new, new.select("node", "comp")
        if new.where("comp <> was").isEmpty():
            free(edges)
            return state


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of rows that agree on keys, from sorted batches; a run may span batches."""
    rest: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is None:
            break
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if rest and any(rest[-1].column(k)[0].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]
            rest = []
        for x, y in itertools.pairwise(bounds[:-1]):
            yield pa.Table.from_batches([*rest, batch.slice(x, y - x)]).combine_chunks().to_batches()[0]
            rest = []
        rest.append(batch.slice(bounds[-2]))
    if rest:
        yield pa.Table.from_batches(rest).combine_chunks().to_batches()[0]


def numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def open_rows(group: pa.RecordBatch, least: int, similarity: float) -> np.ndarray:
    """Which rows of a block have a partner in another component that sizes and minhashes allow and that no earlier
    table brings together: each pair is looked at in one bucket only."""
    pos, low, high, mine, comp, size = numbers(group, "pos", "low", "high", "mine", "comp", "n_shingles")
    a, b = (np.array(group.column(c).to_pylist(), np.int64) for c in ("a", "b"))
    sig = shared(group.column("sig").to_pylist())
    i, j = divmod(int(pos[0]), a.shape[1])
    out = np.zeros(len(comp), bool)
    for start in range(0, len(comp), 128):
        part = slice(start, start + 128)
        ok = comp[part, None] != comp[None, :]
        if low[0] != high[0]:
            ok &= mine[part, None] != mine[None, :]
        ok &= np.minimum(size[part, None], size[None, :]) >= similarity * np.maximum(size[part, None], size[None, :]) - 1e-9
        for values, first in ((a, i), (b, j)):
            for k in range(first):
                ok &= values[part, None, k] != values[None, :, k]
        if not ok.any():
            continue
        same = np.zeros(ok.shape, np.int16)
        for k in range(sig.shape[1]):
            same += sig[part, None, k] == sig[None, :, k]
        ok &= same >= least
        out[part] |= ok.any(1)
        out |= ok.any(0)
    return out


def joined_rows(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """For each set, the first one of the block that a chain of links leads to. Intersections of all pairs are a matrix
    product over the shingles that two sets or more hold, so nothing is emitted for a pair."""
    n = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(n), sizes)
    _, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times[inverse] > 1
    owner, inverse = owner[common], np.unique(inverse[common], return_inverse=True)[1]
    order = np.argsort(inverse, kind="stable")
    owner, inverse = owner[order], inverse[order]
    both = np.zeros((n, n), np.float32)
    width = 4096
    for start in range(0, int(inverse[-1]) + 1 if len(inverse) else 0, width):
        x, y = np.searchsorted(inverse, [start, start + width])
        block = np.zeros((n, width), np.float32)
        block[owner[x:y], inverse[x:y] - start] = 1
        both += block @ block.T
    inter = np.rint(both).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - inter
    linked = (100 * inter >= percent * union) & (union > 0)
    np.fill_diagonal(linked, True)
    label = np.arange(n)
    while True:
        lower = np.where(linked, label[None, :], n).min(1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def labelled(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    return staged(nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node")), "near-members")


def mixed_buckets(members: DataFrame, keys: DataFrame) -> DataFrame:
    """key, n, lo, hi of the buckets among keys that hold rows of several components."""
    found = bucket_keys(members, ["comp"], keys).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    return staged(found.where("n > 1 AND lo <> hi"), "near-mixed")  # none that isn't in keys: components only grow


def stars(members: DataFrame, mixed: DataFrame, round_: int) -> DataFrame:
    """Pairs (u, v) of each bucket's lead of this round, and its rows of other components."""
    order = F.struct(F.xxhash64("node", F.lit(round_)), F.col("node"), F.col("comp"))
    rows = with_group(bucket_keys(members, ["node", "comp"], mixed.select("key")), ["key"], ["node"], order)
    return rows.where(F.col("comp") != F.col("least.comp")).select(F.col("least.node").alias("u"), F.col("node").alias("v")).where("u <> v").distinct()


def crossing(docs: DataFrame, members: DataFrame, mixed: DataFrame, percent: int, words: int) -> DataFrame | None:
    """Edges (u, v) between components that a bucket's comparison in blocks joins, at most one for each row of a block."""
    similarity = percent / 100
    least = least_shared(similarity, 4 * tables(similarity))
    if mixed.isEmpty():
        return None
    rows = bucket_keys(members, ["node", "comp", "n_shingles", "a", "b", "sig"], mixed.select("key")).join(mixed.select("key", "n"), "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    block = ("key", "low", "high")
    near = rows.select(*block, "pos", "mine", "node", "comp", "n_shingles", "a", "b", "sig").repartition(*block).sortWithinPartitions(*block)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, block):
            if group.num_rows > 1:
                keep = open_rows(group, least, similarity)
                if keep.any():
                    yield group.select([*block, "node"]).filter(pa.array(keep))

    found = staged(near.mapInArrow(find, "key long, low int, high int, node long"), "near-open")
    if found.isEmpty():
        return None
    texts = likely(docs.select(F.col("doc_id").alias("node"), "text"), staged(found.select("node").distinct(), "near-ends"), ["node"])
    dealt = found.join(texts, "node").select(*block, "node", "text").repartition(*block).sortWithinPartitions(*block)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, block):
            label = joined_rows(shingle_sets(byte_texts(group.column("text")), words), percent)
            node = group.column("node").to_numpy()
            moved = label != np.arange(len(label))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[moved]]), pa.array(node[moved])], names=["u", "v"])

    return dealt.mapInArrow(join, "u long, v long").where("u <> v").distinct()


def near_dedup(docs: DataFrame, percent: int = 85, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    require_whole(docs, "doc_id")
    similarity = percent / 100
    found = staged(sketches(docs, similarity, words), "near-sketches")
    usable = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    classes = staged(with_group(found.where(usable), ["digest"], ["doc_id"], F.col("doc_id")).withColumnRenamed("least", "node").drop("size"), "near-classes")
    nodes = staged(classes.where("doc_id = node").drop("doc_id").dropDuplicates(["node", "digest"]).select("node", "n_shingles", "a", "b", "sig"), "near-nodes")
    buckets = staged(bucket_keys(nodes, ["node"]).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi"), "near-buckets")
    first = staged(plausible(stars(nodes.withColumn("comp", F.col("node")), buckets, 0), nodes, similarity), "near-stars")
    # texts that share a doc_id belong to one vertex
    repeated = classes.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).where("u <> v")
    same = classes.select("doc_id", "node").join(repeated.select("doc_id", "u"), "doc_id").where("u <> node").select("u", F.col("node").alias("v"))
    links = staged(verified(first, docs, percent, words).union(same.distinct()), "near-links")
    labels = components(links)
    for round_ in range(1, ROUNDS + 2):
        members = labelled(nodes, labels)
        mixed = mixed_buckets(members, buckets.select("key"))
        large = mixed.where(F.col("n") > LARGE)
        if round_ > ROUNDS or large.isEmpty():
            more = crossing(docs, members, mixed, percent, words)
            if more is not None:
                labels = components(links.union(staged(more, "near-crossing")))
            break
        tested = staged(plausible(stars(members, large, round_), nodes, similarity), "near-stars")
        links = links.union(staged(verified(tested, docs, percent, words), "near-links"))
        labels, buckets = components(links), mixed
    placed = classes.join(labels, "node", "left").select("doc_id", "n_shingles", F.coalesce("comp", "node").alias("component_id"))
    alone = found.where(~usable | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    whole = placed.select(F.col("doc_id").alias("id"), F.col("component_id").alias("of_id")).where("of_id < id").distinct()
    alone = alone.join(whole, alone.doc_id == whole.id, "left").select("doc_id", "n_shingles", F.coalesce("of_id", "component_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that `near_dedup` keeps, with docs' own columns: rows surely kept stay where they are, and only
    texts of ids that may go are moved, to be held against the verdicts."""
    gone = staged(near_dedup(docs, **options).where("NOT kept").select("doc_id").distinct(), "near-gone")
    sure, doubtful = likely(docs, gone, ["doc_id"], negate=True), likely(docs, gone, ["doc_id"])
    return sure.unionByName(doubtful.join(gone, "doc_id", "left_anti").select(*docs.columns))
