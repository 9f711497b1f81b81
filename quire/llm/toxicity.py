"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams (hashed to a fixed table); a passage is the mean of its
words; a linear softmax marks it. With `passage=None` the passage is the whole text. With a number, a text is as toxic as
its most toxic passage of so many words, so that a few words count in a long text as in a short one; in training, the
passage that the model marks highest stands for its text. As the n-grams carry the vectors, a misspelling unseen in
training shares most of a known word's. The README has the figures of both.

The model is linear after the means, so scoring needs one number for each n-gram, and one for each word met.

Defined results: null or empty text scores what the model gives a text without words (its bias, below 0.5); words are
the runs of non-white-space, with A-Z lowered and ASCII punctuation stripped at both ends; one of over LONGEST code points
(text without spaces, URLs) counts as words of PIECE code points that overlap by half, so that every part of it is seen;
without labelled rows of both kinds every score is 0. Memory: texts in runs of 2 MB; the word store starts anew when full.

The bound of the training sample is `sample` rows and `sample_bytes` bytes of text a class, in the order of a hash of the
doc_id; scores cover all rows. Of labelled rows that share a doc_id, the one whose text has the least hash is taken. A null
doc_id is scored, never held out and never learnt from.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import byte_texts, slices

BUCKETS = 1 << 16
WIDTH = 8
PASSAGE = 2
SHORT, LONG = 3, 6
#: Code points of the longest word that is taken whole, and of the pieces of longer ones.
LONGEST, PIECE = 64, 16
#: Rows, and bytes of text, of each class in the training sample.
SAMPLE = 3000
SAMPLE_BYTES = 48_000_000
STRIP = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def words_of(text: bytes) -> list[bytes]:
    words = [w for w in (x.strip(STRIP) for x in text.lower().split()) if w]
    if max(map(len, words), default=0) > LONGEST:
        return [p for w in words for p in pieces(w)]
    return words


def pieces(word: bytes) -> list[bytes]:
    """The word, or overlapping pieces of a long one; a space marks an end of a piece that is none of the word."""
    if len(word) <= LONGEST:
        return [word]
    s = word.decode("utf-8", "replace")
    if len(s) <= LONGEST:
        return [word]
    starts = range(0, len(s) - PIECE // 2, PIECE // 2)
    return [(" " * (i > 0) + s[i : i + PIECE] + " " * (i + PIECE < len(s))).encode() for i in starts]


def grams(word: bytes) -> list[int]:
    """Table rows of the character n-grams (of code points) of a word or piece and of all of it, a word's ends marked."""
    s = f"<{word.decode('utf-8', 'replace')}>".removeprefix("< ").removesuffix(" >")
    found = {zlib.crc32(s[i : i + n].encode()) % BUCKETS for n in range(SHORT, LONG + 1) for i in range(len(s) - n + 1)}
    found.add(zlib.crc32(b"=" + word) % BUCKETS)
    return sorted(found)


class Model:
    """gram_score: what each n-gram adds to the log odds of a word; bias: the log odds of nothing."""

    def __init__(self, gram_score: np.ndarray, bias: float, passage: int | None = PASSAGE):
        self.gram_score, self.bias, self.passage = gram_score, bias, passage
        self.known: dict[bytes, float] = {}

    def __getstate__(self):
        return self.gram_score, self.bias, self.passage

    def __setstate__(self, state):
        self.__init__(*state)

    def word(self, w: bytes) -> float:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > 500_000:
                self.known.clear()
            got = self.known[w] = float(self.gram_score[grams(w)].mean())
        return got

    def score(self, text: bytes) -> float:
        """The probability of the highest passage."""
        words = words_of(text)
        if not words:
            top = 0.0
        else:
            s = np.fromiter(map(self.word, words), float, len(words))
            n = min(self.passage or len(s), len(s))
            total = np.cumsum(np.concatenate([[0.0], s]))
            top = float((total[n:] - total[:-n]).max()) / n
        return float(1 / (1 + np.exp(-np.clip(top + self.bias, -500, 500))))


def train(texts: list[bytes], marks: np.ndarray, epochs: int = 8, rate: float = 0.5, least: int = 3, passage: int | None = PASSAGE, whole: int = 1, seed: int = 5) -> Model:
    """Joint training of the n-gram vectors and the softmax with Adagrad; a text's highest passage stands for it,
    after `whole` epochs on whole texts, which find the words that matter.

    Words of fewer than `least` texts aren't learnt from: else a text with a wrong mark is learnt by heart. (Of 1,272
    rows in two folds of the training rows, 1,257 are marked rightly with least=3, and 1,251 with least=1.)
    """
    whole = whole if passage else epochs
    rng = np.random.default_rng(seed)
    split = [words_of(t) for t in texts]
    times = Counter(w for x in split for w in set(x))
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in x if times[w] >= least], np.int64) for x in split]
    if not vocabulary:
        return Model(np.zeros(BUCKETS), -500.0, passage)
    lists = [np.array(grams(w), np.int32) for w in vocabulary]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.concatenate(lists)
    del lists, split, times
    ends = np.cumsum(sizes)
    starts = ends - sizes
    table = rng.uniform(-1, 1, (BUCKETS, WIDTH)) / WIDTH
    softmax = np.zeros((WIDTH, 2))
    softmax[:, 1] = rng.uniform(-1, 1, WIDTH)
    bias = np.array([0.0, -2.0])
    sq_table, sq_softmax, sq_bias = np.full(BUCKETS, 1e-4), np.full(softmax.shape, 1e-4), np.full(2, 1e-4)
    positive = marks == 1
    weight = np.where(positive, np.sqrt((~positive).sum() / max(1, positive.sum())), 1.0)
    filled = [i for i in range(len(docs)) if len(docs[i])]
    for epoch in range(epochs):
        rng.shuffle(filled)
        for at in range(0, len(filled), 128):
            some = filled[at : at + 128]
            odds = softmax[:, 1] - softmax[:, 0]
            scalar = table @ odds
            per_word = np.add.reduceat(scalar[flat], starts) / sizes
            passages = []
            for i in some:
                d = docs[i]
                if epoch < whole:
                    passages.append(d)
                    continue
                n = min(passage, len(d))
                total = np.cumsum(np.concatenate([[0.0], per_word[d]]))
                means = total[n:] - total[:-n]
                p = int(means.argmax())
                passages.append(d[p : p + n])
            counts = np.fromiter(map(len, passages), np.int64, len(passages))
            words = np.concatenate(passages)
            used = np.concatenate([flat[starts[w] : ends[w]] for w in words])
            word_of = np.repeat(np.arange(len(words)), sizes[words])
            text_of = np.repeat(np.arange(len(some)), counts)
            vectors = np.zeros((len(words), WIDTH))
            np.add.at(vectors, word_of, table[used])
            vectors /= sizes[words][:, None]
            bag = np.zeros((len(some), WIDTH))
            np.add.at(bag, text_of, vectors)
            bag /= counts[:, None]
            logits = bag @ softmax + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), positive[some].astype(int)] -= 1
            p *= weight[some][:, None]
            g_bag = p @ softmax.T / counts[:, None]
            g_softmax, g_bias = bag.T @ p / len(some), p.mean(0)
            g_used = (g_bag[text_of] / sizes[words][:, None])[word_of]
            g_table = np.zeros((BUCKETS, WIDTH))
            np.add.at(g_table, used, g_used)
            rows = np.unique(used)
            sq_table[rows] += (g_table[rows] ** 2).mean(1)
            table[rows] -= rate * g_table[rows] / np.sqrt(sq_table[rows])[:, None]
            sq_softmax += g_softmax**2
            softmax -= 0.1 * g_softmax / np.sqrt(sq_softmax)
            sq_bias += g_bias**2
            bias -= 0.1 * g_bias / np.sqrt(sq_bias)
    return Model(table @ (softmax[:, 1] - softmax[:, 0]), float(min(bias[1] - bias[0], -0.1)), passage)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, passage: int | None = PASSAGE) -> Model:
    """Trains on labelled rows that aren't held out, up to `sample` rows and `sample_bytes` bytes of text of each class.

    Their ids, at most 2 * sample, are the only thing that is broadcast, and their texts the only ones collected.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("toxic = 0").orderBy(*order).limit(sample).unionByName(marked.where("toxic = 1").orderBy(*order).limit(sample))
    text = F.coalesce("text", F.lit(""))
    met = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash")).join(F.broadcast(chosen), "doc_id")
    slim = met.select("doc_id", "toxic", "hash", F.octet_length("text").cast("long").alias("size")).groupBy("doc_id").agg(F.min(F.struct("hash", "size", "toxic")).alias("r"))
    slim = slim.select("doc_id", "r.hash", "r.toxic", F.sum("r.size").over(Window.partitionBy("r.toxic").orderBy(*order)).alias("upto"))  # at most 2 * sample rows
    rows = met.join(F.broadcast(slim.where(F.col("upto") <= sample_bytes).select("doc_id", "hash")), ["doc_id", "hash"]).dropDuplicates(["doc_id", "hash"])
    got = sorted(rows.select("doc_id", "toxic", "text").collect(), key=lambda r: r["doc_id"])
    marks = np.array([r["toxic"] for r in got], np.int64)
    if len(set(marks.tolist())) < 2:
        return Model(np.zeros(BUCKETS), -500.0, passage)
    return train([r["text"].encode("utf-8") for r in got], marks, passage=passage)


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row: one pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                s = [model.score(t) for t in byte_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return score_documents(docs, fit(docs, labels, **options))
