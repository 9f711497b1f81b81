"""Watching a folder: new and changed files of each trigger, extracted and handed to a sink.

Spark's file source keys files by path and doesn't give a changed file again, so state is a table of
(path, modificationTime, length) beside the output: each trigger lists the folder, an anti join with the state leaves what is
new or newer, and the batch's listing becomes part of the state after the sink has succeeded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.functions import text as T
from quire.sources.read import parse_files

STATE = "path string, modificationTime timestamp, length long"


def pattern_column(pattern: str, path: str = "path"):
    """A condition for "*.md", ".md", "md" or a comma list of these, whatever the case."""
    name = F.lower(T.file_name(path))
    cond = F.lit(False)
    for p in (x.strip().lower() for x in pattern.split(",") if x.strip()):
        glob = p if any(c in p for c in "*?[") else "*" + (p if p.startswith(".") else f".{p}")
        regex = "".join({"*": ".*", "?": "."}.get(c, c if c in "[]" else "\\" + c if not c.isalnum() else c) for c in glob)
        cond = cond | name.rlike(f"^{regex}$")
    return cond


def listing(spark: SparkSession, folder: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """path, modificationTime, length of the folder's files; contents aren't read, as their column isn't selected."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", "modificationTime", "length")
    return files.where(pattern_column(pattern)) if pattern else files


def read_state(spark: SparkSession, state: str) -> DataFrame:
    """The latest entry of each path; nothing before the first batch."""
    try:
        table = spark.read.schema(STATE).parquet(state)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        table = spark.createDataFrame([], STATE)
    return table.groupBy("path").agg(F.max("modificationTime").alias("modificationTime"), F.max_by("length", "modificationTime").alias("length"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Files that are new, or newer than before."""
    known = before.select("path", F.col("modificationTime").alias("seen"))
    return now.join(known, "path", "left").where("seen IS NULL OR modificationTime > seen").drop("seen")


def poll(spark: SparkSession, folder: str, state: str, sink: Callable[[DataFrame], None], pattern: str | None = None, recursive: bool = True) -> int:
    """One round: extracts what changed, gives it to the sink, then remembers it. The number of files."""
    fresh = changed(listing(spark, folder, pattern, recursive), read_state(spark, state)).collect()
    if fresh:
        todo = spark.createDataFrame(fresh, STATE)
        content = spark.read.format("binaryFile").load([r["path"] for r in fresh]).select("path", "content")
        sink(parse_files(content))
        todo.write.mode("append").parquet(state)
    return len(fresh)


def seed(spark: SparkSession, folder: str, state: str, pattern: str | None = None) -> None:
    """Marks the files that are there as seen, so that only later changes are handled."""
    listing(spark, folder, pattern).write.mode("append").parquet(state)


def watch(spark: SparkSession, folder: str, state: str, sink: Callable[[DataFrame], None], interval: str = "2 seconds", pattern: str | None = None, recursive: bool = True, checkpoint: str | None = None) -> StreamingQuery:
    """Polls at every trigger of a rate stream until the query is stopped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.trigger(processingTime=interval).foreachBatch(lambda batch, n: poll(batch.sparkSession, folder, state, sink, pattern, recursive) and None)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()


def stream_new_files(spark: SparkSession, folder: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """Extracted documents of new files as a stream (files that change later aren't seen again)."""
    source = spark.readStream.format("binaryFile").schema(f"{STATE}, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower())
    return parse_files(source.load(folder).select("path", "content"))
