"""What the operators share: shared-folder staging, batch slicing and grouping that survives hot keys."""

from __future__ import annotations

import atexit
import itertools
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words: bytes.split() and the regex class below agree.
WHITESPACE = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

_written: list[tuple[SparkSession, str]] = []


def require_whole(df: DataFrame, column: str) -> None:
    """Raises unless the id column holds whole numbers."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{column} must be a whole number, not {kind}")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir, or in local mode one of our own."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return spark.sparkContext.getCheckpointDir()


def staged_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/quire-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: later reads neither recompute it nor depend on the executors that made it."""
    path = staged_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again: the rounds of a loop would fill the shared folder else."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            for found in [w for w in _written if f"/{w[1].rsplit('/', 1)[1]}/" in file]:
                _remove(*found)
                _written.remove(found)


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended before
            continue


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts come to limit bytes or to one long text, so that memory follows the limit."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def byte_texts(array: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def free_arrow() -> None:
    """Gives back what Arrow holds of past batches: workers stay, and their pools would add up on an executor."""
    pa.default_memory_pool().release_unused()


def word_ids(split: list[list[bytes]], known: dict[bytes, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Dense numbers of all words in order, and the number of words of each text."""
    known = {} if known is None else known
    counts = np.fromiter(map(len, split), np.int64, len(split))
    number = known.setdefault
    ids = np.fromiter((number(w, len(known)) for w in itertools.chain.from_iterable(split)), np.int64, int(counts.sum()))
    return ids, counts


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of unsigned 64-bit numbers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def salt(columns: list[str | Column], salts: int) -> Column:
    """A number below salts that spreads the rows of any one key."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def with_group(rows: DataFrame, keys: list[str], spread: list[str], first: Column, salts: int = 64) -> DataFrame:
    """Adds to each row of its key's group `least` (the least value of `first`) and `size`, with no task that holds a group.

    Groups are summed by (key, salt), then by key; the result goes back to the at most `salts` rows that a key
    has in the first sum, and from there to the rows by (key, salt). So a key that owns a third of all rows
    lands in `salts` tasks, and a key with one row costs one slim row. Null keys form a group like any other.
    """
    salted = rows.withColumn("_salt", salt(spread, salts))
    part = salted.groupBy(*keys, "_salt").agg(F.min(first).alias("_least"), F.count(F.lit(1)).alias("_size"))
    whole = part.groupBy(*keys).agg(F.min("_least").alias("least"), F.sum("_size").alias("size"))
    back = part.alias("p").join(whole.alias("w"), same_all("p", "w", keys), "inner").select(*[F.col(f"p.{k}").alias(k) for k in [*keys, "_salt"]], "w.least", "w.size")
    out = salted.alias("r").join(back.alias("b"), same_all("r", "b", [*keys, "_salt"]), "inner")
    return out.select(*[F.col(f"r.`{c}`").alias(c) for c in rows.columns], F.col("b.least").alias("least"), F.col("b.size").alias("size"))


def same_all(left: str, right: str, names: list[str]) -> Column:
    """left.k <=> right.k for all names: an equi-join that also matches nulls."""
    cond = F.lit(True)
    for k in names:
        cond = cond & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return cond


CHUNK_BITS = 16


def write_bitmap(keys: DataFrame, bits: int) -> str:
    """Marks the values of the column `key` (long, hashed) in a bitmap of 2 ** bits, written to the shared folder in chunks.

    Its size is fixed. Testing a key against it never misses one that is there, and lets a few others through.
    """
    size = 1 << CHUNK_BITS
    bit = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    rows = keys.select(bit.alias("bit")).distinct().withColumn("chunk", F.shiftright("bit", CHUNK_BITS).cast("int")).repartition("chunk").sortWithinPartitions("chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, marks = None, np.zeros(size, bool)
        out = lambda: pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(marks).tobytes()])], names=["chunk", "bits"])
        for batch in batches:
            chunks, at = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "bit"))
            for c in np.unique(chunks):
                if c != chunk:
                    if chunk is not None:
                        yield out()
                    chunk, marks = int(c), np.zeros(size, bool)
                marks[at[chunks == c] & (size - 1)] = True
        if chunk is not None:
            yield out()

    folder = staged_path(keys.sparkSession, "bitmap")
    rows.mapInArrow(run, "chunk int, bits binary").write.parquet(folder)
    return folder


@lru_cache(maxsize=1)
def read_bitmap(folder: str, bits: int) -> np.ndarray:
    """The bitmap as bytes, once for each Python worker."""
    files, base = open_folder(folder)
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << CHUNK_BITS) // 8
    for info in files.get_file_info(fs.FileSelector(base)):
        if info.path.endswith(".parquet"):
            with files.open_input_file(info.path) as f:
                for row in pq.read_table(f, use_threads=False).to_pylist():
                    out[row["chunk"] * size : (row["chunk"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return out


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & (len(bitmap) * 8 - 1)
    return (bitmap[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1 == 1


#: Most bits of the bitmaps that stand before joins; 2 ** 29 are 64 MB in each Python worker.
JOIN_BITS = 29


def bits_for(n: int, most: int = JOIN_BITS) -> int:
    """Bits of a bitmap for n keys: 16 to 32 a key, up to the bound; beyond it more keys pass that aren't there."""
    return min(most, max(CHUNK_BITS, (16 * max(n, 1)).bit_length()))


def likely(rows: DataFrame, ids: DataFrame, columns: list[str | Column], negate: bool = False) -> DataFrame:
    """The rows whose `columns` are in ids (its columns, in order), and a few others: what a join needs not shuffle is
    left out here. Negated, the rows that surely aren't in ids. ids should be a staged table, as it is read twice."""
    bits = bits_for(ids.count())
    folder = write_bitmap(ids.select(F.xxhash64(*[F.col(c) for c in ids.columns]).alias("key")), bits)
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = read_bitmap(folder, bits)
        for batch in batches:
            keep = in_bitmap(marks, batch.column("__key").to_numpy(zero_copy_only=False)) ^ negate
            for start in range(0, batch.num_rows, 512):  # small batches: both sides hold one of them at a time
                some = keep[start : start + 512]
                if some.any():
                    yield batch.slice(start, 512).filter(pa.array(some)).select(names)
            free_arrow()

    return rows.withColumn("__key", F.xxhash64(*columns)).mapInArrow(run, rows.schema)


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder in the shared place, for Python workers."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
