"""Running prose: soft wraps undone, sentences that abbreviations don't end, list markers, and a check of where pieces end.

A text's lines are windows by document; the rest is expressions of one row. Null texts give no rows or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.page_lines import ABBREVIATIONS
from quire.operators.structure import text_lines

MASK = "\u0002"
EDGE = r"(?<![\p{L}\p{N}_])"
SHORT = "|".join(a[:-1].replace(".", r"\.") for a in sorted((a for a in ABBREVIATIONS if a.endswith(".")), key=len, reverse=True))
#: Lines that stay lines: tables, headings, quotes, list items.
KEPT_LINE = r"^\s*(\||#{1,6}\s|>|[-*+•]\s|\(?[0-9]{1,3}[.)]\s)"
MARKER = r"^\s*([-*+•◦▪‣–]|\([a-z]{1,4}\)|[ivxlc]{1,6}\)|[0-9]{1,3}[.)]|[a-z]\))\s+(\S.*)$"


def masked(text: str | Column) -> Column:
    """Stops after abbreviations and single initials, ahead of white space, replaced by a control character."""
    t = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.regexp_replace(t, rf"{EDGE}({SHORT})\.(\s)", f"$1{MASK}$2"), rf"{EDGE}([A-Z])\.(\s)", f"$1{MASK}$2")


def safe_sentences(text: str | Column) -> Column:
    """Sentences, each trimmed; a stop of an abbreviation or an initial ends none."""
    parts = F.split(F.regexp_replace(masked(text), r"([.!?][\"')\]]*)\s+", "$1\u0001"), "\u0001")
    return F.filter(F.transform(parts, lambda s: F.replace(T.strip(s), F.lit(MASK), F.lit("."))), lambda s: s != "")


def reflowed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text with soft wraps undone: neighbouring plain lines are joined by a space, or by nothing where a word was
    divided by a hyphen before a small letter. Blank lines, fenced code and KEPT_LINE's kinds keep their line ends."""
    rows = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(text_lines(text)).alias("n", "line"))
    w = Window.partitionBy(key).orderBy("n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    fence = F.trim("line").startswith("```")
    plain = ~fence & (F.sum(fence.cast("int")).over(so_far) % 2 == 0) & (T.strip("line") != "") & ~F.col("line").rlike(KEPT_LINE)
    marked = rows.withColumn("_plain", plain).withColumn("_before", F.lag("_plain").over(w)).withColumn("_last", F.lag("line").over(w)).withColumn("_next_plain", F.lead("_plain").over(w)).withColumn("_next", F.lead("line").over(w))
    divided = lambda a, b: F.col(a).rlike(r"\p{L}-\s*$") & F.col(b).rlike(r"^\s*\p{Ll}")
    joins, joined_on = F.col("_plain") & F.col("_before"), F.col("_plain") & F.col("_next_plain")
    glue = F.when(F.col("n") == 0, "").when(joins & divided("_last", "line"), "").when(joins, " ").otherwise("\n")
    body = F.when(joins, F.regexp_replace("line", r"^\s+", "")).otherwise(F.col("line"))
    cut = F.when(joined_on & divided("line", "_next"), F.regexp_replace(body, r"-\s*$", "")).when(joined_on, F.regexp_replace(body, r"\s+$", "")).otherwise(body)
    parts = marked.select(key, "n", F.concat(glue, cut).alias("part"))
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda p: p["part"]), "").alias("text"))


def bad_cuts(pieces: DataFrame, docs: DataFrame, key: str = "doc_id", order: str = "chunk_id", text: str = "text") -> DataFrame:
    """key, order, at: pieces whose end isn't the end of a sentence, compared by characters that aren't white space."""
    solid = lambda c: F.length(F.regexp_replace(c, T.SPACE + "+", ""))
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = pieces.select(key, order, F.sum(solid(text)).over(w).alias("at"))
    told = docs.select(key, F.posexplode(safe_sentences(text)).alias("n", "sentence"))
    stops = told.select(key, F.sum(solid("sentence")).over(Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)).alias("at"))
    return ends.join(stops, [key, "at"], "left_anti").select(key, order, "at")


def list_marker(text: str | Column) -> Column:
    """(marker, item) of a line that starts a list item, or null: bullets, (a), iv), 12) and 3., but not 1.2 or -5."""
    t = F.col(text) if isinstance(text, str) else text
    return F.when(t.rlike(MARKER), F.struct(F.regexp_extract(t, MARKER, 1).alias("marker"), F.regexp_extract(t, MARKER, 2).alias("item")))


def chunk_statistics(chunks: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, total_chunks, total_words, average_words (whole words, rounded down)."""
    n = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("total_chunks"), F.sum(T.word_count(text)).alias("total_words"))
    return n.withColumn("average_words", F.floor(F.col("total_words") / F.col("total_chunks")))
