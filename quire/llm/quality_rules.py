"""Quality rules: an isolation forest over rule statistics.

Every text gets rule statistics (shares of symbols, capitals, repeated words and lines ...). A forest of random
splits is grown on a bounded sample of trusted labelled rows; a document that few splits isolate is unlike them.
The score at which a document goes is calibrated on all labelled rows of both classes, through histograms of fixed
width. A row of the sample is scored by the trees that were not grown on it, so that the calibration sees it as new.

Defined results: null or empty text has no words and fails the base rules; a null doc_id keeps its row; repeated
rows are judged alike; without labelled rows (or none trusted) the forest rejects nothing; further columns of the
input are ignored by `judge`. Memory: texts are handled in runs of 2 MB, or one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_texts, mix64, slices, staged, word_ids

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
LETTERS_UP = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in b".,")
WINDOW = 5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_punctuation", "n_echoes"]
#: Rows for the forest: the bound on the sample of trusted labelled rows.
SAMPLE = 8192
BINS = 2000


def repeated_words(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in a 5-word window found twice or more in that text."""
    n = len(ids)
    out = np.zeros(len(counts), np.int64)
    if n < WINDOW:
        return out
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    if not len(at):
        return out
    word = mix64(ids.astype(np.uint64) + np.uint64(1))
    key = mix64(doc[at].astype(np.uint64) + np.uint64(7))
    for k in range(WINDOW):
        key = key * np.uint64(0x9E3779B97F4A7C15) + word[at + k]
    order = np.argsort(key)
    key = key[order]
    twin = np.zeros(len(key), bool)
    equal = key[1:] == key[:-1]
    twin[1:] |= equal
    twin[:-1] |= equal
    at = at[order[twin]]
    if not len(at):
        return out
    whole = np.column_stack([doc[at], *(ids[at + k] for k in range(WINDOW))])  # the words themselves decide
    _, inverse, times = np.unique(whole, axis=0, return_inverse=True, return_counts=True)
    at = at[times[inverse.ravel()] > 1]
    covered = np.zeros(n, bool)
    for k in range(WINDOW):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=len(counts)).astype(np.int64)


def echoes(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, its words that equal the word before."""
    doc = np.repeat(np.arange(len(counts)), counts)
    same = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    return np.bincount(doc[1:][same], minlength=len(counts)).astype(np.int64)


def counts_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    split = [t.split() for t in texts]
    ids, n = word_ids(split)
    without = lambda t, drop: len(t) - len(t.translate(None, drop))
    lines = [[x for x in t.split(b"\n") if x and not x.isspace()] for t in texts]
    column = lambda f, of: np.fromiter((f(x) for x in of), np.int64, len(texts))
    return {
        "n_words": n,
        "word_chars": column(lambda t: len(t.decode("utf-8", "replace")) - without(t, SPACES), texts),
        "n_symbols": column(lambda t: without(t, SYMBOLS), texts),
        "n_dup_lines": column(lambda x: len(x) - len(set(x)), lines),
        "n_repeat_words": repeated_words(ids, n),
        "n_lines": column(len, lines),
        "n_upper": column(lambda t: without(t, LETTERS_UP), texts),
        "n_digits": column(lambda t: without(t, DIGITS), texts),
        "n_punctuation": column(lambda t: without(t, PUNCTUATION), texts),
        "n_echoes": echoes(ids, n),
    }


def rule_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and the counts of COUNTS (long) for every row; one pass, no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = counts_of(byte_texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(got[c]) for c in COUNTS)], names=["doc_id", *COUNTS])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(c: dict[str, np.ndarray]) -> np.ndarray:
    """Shares, so that a text's length alone makes nothing odd."""
    c = {k: np.asarray(v, float) for k, v in c.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    return np.column_stack([
        np.minimum(c["word_chars"] / words, 20),
        np.minimum(c["n_symbols"] / words, 3),
        c["n_dup_lines"] / lines,
        c["n_repeat_words"] / words,
        c["n_upper"] / chars,
        c["n_digits"] / chars,
        c["n_punctuation"] / chars,
        c["n_echoes"] / words,
    ])


class Forest:
    """Isolation trees as flat arrays; a split is a random feature and a random point of its range in the tree's rows.

    The range is widened by `margin` on both sides: a value beyond all trusted rows can then be split off near
    the root, which plain trees grown on trusted rows alone could not do.
    """

    def __init__(self, rows: np.ndarray, trees: int = 100, size: int = 256, margin: float = 1.0, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.size = max(2, min(size, len(rows)))
        depth = int(np.ceil(np.log2(self.size)))
        spread = rows.max(0) - rows.min(0)
        self.trees, self.grown_on = [], []
        for _ in range(trees):
            some = rng.choice(len(rows), self.size, replace=len(rows) < self.size)
            self.trees.append(self._grow(rows[some], spread, depth, margin, rng))
            self.grown_on.append(np.unique(some))

    @staticmethod
    def _grow(rows, spread, depth, margin, rng):
        feature, cut, left, right, path = [], [], [], [], []

        def average(n):
            return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

        def node(x, level, low, high):
            me = len(feature)
            feature.append(-1), cut.append(0.0), left.append(me), right.append(me), path.append(level + average(len(x)))
            usable = np.flatnonzero(high > low)
            if level >= depth or not len(x) or not len(usable):
                return me
            f = int(rng.choice(usable))
            at = float(rng.uniform(low[f], high[f]))
            below = x[:, f] < at
            feature[me], cut[me] = f, at
            top, bottom = high.copy(), low.copy()
            top[f], bottom[f] = at, at
            left[me], right[me] = node(x[below], level + 1, low, top), node(x[~below], level + 1, bottom, high)
            return me

        pad = margin * np.where(spread > 0, spread, 0.01)
        node(rows, 0, rows.min(0) - pad, rows.max(0) + pad)
        return tuple(np.array(a) for a in (feature, cut, left, right, path))

    def paths(self, x: np.ndarray, tree: tuple) -> np.ndarray:
        feature, cut, left, right, path = tree
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            go = f >= 0
            if not go.any():
                return path[at]
            below = x[np.arange(len(x)), np.maximum(f, 0)] < cut[at]
            at = np.where(go, np.where(below, left[at], right[at]), at)

    def _anomaly(self, mean_path: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / expected path): near 1 for rows that few splits isolate."""
        n = self.size
        expected = 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0
        return 2.0 ** (-mean_path / expected)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._anomaly(sum(self.paths(x, t) for t in self.trees) / len(self.trees))

    def score_unseen(self, rows: np.ndarray) -> np.ndarray:
        """Scores of the rows that the forest was given, each by the trees that weren't grown on it (by all, if there are none)."""
        total, times = np.zeros(len(rows)), np.zeros(len(rows))
        for tree, grown in zip(self.trees, self.grown_on, strict=True):
            new = np.ones(len(rows), bool)
            new[grown] = False
            total[new] += self.paths(rows[new], tree)
            times[new] += 1
        return np.where(times > 0, self._anomaly(total / np.maximum(times, 1)), self.score(rows))


def score_column(stats: DataFrame, forest: Forest | None) -> DataFrame:
    """stats with `anomaly` (double, 0 without a forest)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}
            s = forest.score(features(got)) if forest else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "anomaly"])

    return stats.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in stats.dtypes) + ", anomaly double")


def base_failed():
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


class Rules:
    """The fitted forest and the score from which a document goes."""

    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def judge(self, stats: DataFrame) -> DataFrame:
        """stats with anomaly, base_failed and kept."""
        return score_column(stats, self.forest).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(self.threshold)))


def threshold_of(clean: np.ndarray, bad: np.ndarray, clean_loss: float) -> int:
    """The bin from which documents go: the least at which at most `clean_loss` of the clean rows would go, moved to the
    middle of the bins that send as many bad rows away, so that neither class lies at the edge."""
    gone = clean[::-1].cumsum()[::-1]
    least = int(np.argmax(gone <= clean_loss * gone[0]))
    caught = bad[::-1].cumsum()[::-1]
    if not caught[least]:
        return least
    most = int(np.flatnonzero(caught == caught[least])[-1])
    return (least + most) // 2


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE, trees: int = 100, tree_rows: int = 256, clean_loss: float = 0.001) -> Rules:
    """Grows the forest on the `sample` trusted labelled rows (quality 1, base rules passed) of least hash, and sets the
    threshold from the scores of all labelled rows that pass the base rules, of both classes."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = staged(stats.where(~base_failed()).join(marks, "doc_id"), "rules-known")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = known.where("quality = 1").orderBy(*order, *COUNTS).limit(sample).toPandas()
    if len(rows) < 2:
        return Rules(None, 1.0)
    x = features({c: rows[c].to_numpy() for c in COUNTS})
    forest = Forest(x, trees, tree_rows)
    ids = stats.sparkSession.createDataFrame(rows[["doc_id"]].drop_duplicates(), known.select("doc_id").schema)  # at most `sample`
    others = known.join(F.broadcast(ids), "doc_id", "left_anti")
    bins = score_column(others, forest).groupBy(F.floor(F.col("anomaly") * BINS).alias("bin"), "quality").count().collect()
    clean, bad = np.zeros(BINS + 2), np.zeros(BINS + 2)
    np.add.at(clean, np.floor(forest.score_unseen(x) * BINS).astype(int), 1)
    for r in bins:
        (clean if r["quality"] == 1 else bad)[r["bin"]] += r["count"]
    return Rules(forest, threshold_of(clean, bad, clean_loss) / BINS)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, COUNTS, anomaly, base_failed, kept. One pass over the texts; the rest is slim."""
    stats = staged(rule_statistics(docs), "rules")
    return fit(stats, labels, **options).judge(stats)


def keep_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns; scores in place, so texts aren't shuffled."""
    rules = fit(staged(rule_statistics(docs), "rules"), labels, **options)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = counts_of(byte_texts(part.column("text")))
                keep = (got["n_words"] >= 10) & (100 * got["n_repeat_words"] <= 20 * got["n_words"])
                if rules.forest:
                    keep &= rules.forest.score(features(got)) < rules.threshold
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema).select(*names)
