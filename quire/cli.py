"""Command line: spark-submit quire/cli.py PATH --mode parse|chunk|metadata|formats|watch --output compact|json|..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire import api
from quire.operators.chunking import CHUNK_SIZE, OVERLAP, STRATEGIES
from quire.streaming import watch


def arguments(args: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="quire", description="Documents to text, chunks and rendered output")
    p.add_argument("path", nargs="?", help="file or folder")
    p.add_argument("--mode", choices=("parse", "chunk", "metadata", "formats", "watch"), default="parse")
    p.add_argument("--output", choices=tuple(api.Pipeline.RENDERERS), default="compact", help="rendering of chunks")
    p.add_argument("--write", help="folder to write to; without it rows are shown")
    p.add_argument("--format", choices=("json", "csv", "parquet", "text", "xml"), default="json", help="files to write")
    p.add_argument("--strategy", choices=STRATEGIES, default="auto")
    p.add_argument("--chunk-size", type=int, default=CHUNK_SIZE)
    p.add_argument("--overlap", type=int, default=OVERLAP)
    p.add_argument("--max-chars", type=int)
    p.add_argument("--pattern", help="files to watch, such as *.md,.txt")
    p.add_argument("--interval", default="2 seconds")
    p.add_argument("--state", help="folder of the watcher's state")
    found = p.parse_args(args)
    if found.mode != "formats" and not found.path:
        p.error("a path is needed")
    if found.mode == "watch" and not (found.state and found.write):
        p.error("watching needs --state and --write")
    return found


def rows(spark: SparkSession, a: argparse.Namespace):
    if a.mode == "formats":
        return api.list_formats(spark)
    docs = api.parse(spark, a.path, a.max_chars)
    if a.mode == "parse":
        return docs
    if a.mode == "metadata":
        return api.extract_metadata(docs)
    good = docs.where("text IS NOT NULL").withColumn("doc_id", F.col("path"))
    return api.Pipeline(a.strategy, a.chunk_size, a.overlap, a.output).transform(good)


def put(df, a: argparse.Namespace, mode: str = "overwrite") -> None:
    if a.format == "text":
        df = df.select(F.col(df.columns[-1]).cast("string").alias("value"))
    elif a.format == "csv":
        df = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
    writer = df.write.mode(mode)
    writer = writer.option("rowTag", "row") if a.format == "xml" else writer.option("header", "true") if a.format == "csv" else writer
    writer.format(a.format).save(a.write)


def main(args: list[str] | None = None) -> None:
    a = arguments(args)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    if a.mode == "watch":
        watch.seed(spark, a.path, a.state, a.pattern)
        watch.watch(spark, a.path, a.state, lambda docs: put(docs, a, "append"), a.interval, a.pattern).awaitTermination()
    elif a.write:
        put(rows(spark, a), a)
    else:
        rows(spark, a).show(50, truncate=100)


if __name__ == "__main__":
    main()
