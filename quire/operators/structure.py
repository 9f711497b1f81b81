"""Structure of texts and tables as DataFrame operations: lines, paragraphs, pages, noise, duplicates, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

#: What ends a line (fixed values), CRLF first.
LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
INT, FLOAT = r"^[+-]?\d+$", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
YEAR, MONTH, DAY, TIME, NAME = r"[+-]?0*(?:\d{4,5}|1\d{5}|2[0-8]\d{4})", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[0-2]\d:[0-5]\d:[0-5]\d", "(?iu:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
#: Date formats that count as datetime, anything else is text; each with the shape of what its parser may accept. No value
#: has two shapes. The parser throws and catches an exception for each value that it refuses, so it sees no others; years
#: from 290,000, of which some overflow a timestamp and end the job, aren't dates.
DATE_FORMATS = {
    "yyyy-MM-dd": f"{YEAR}-{MONTH}-{DAY}", "yyyy-MM-dd HH:mm:ss": f"{YEAR}-{MONTH}-{DAY} {TIME}", "yyyy-MM-dd'T'HH:mm:ss": f"{YEAR}-{MONTH}-{DAY}[Tt]{TIME}", "yyyy/MM/dd": f"{YEAR}/{MONTH}/{DAY}",
    "MM/dd/yyyy": f"{MONTH}/{DAY}/{YEAR}", "dd.MM.yyyy": rf"{DAY}\.{MONTH}\.{YEAR}", "dd MMM yyyy": f"{DAY} {NAME} {YEAR}", "MMM dd, yyyy": f"{NAME} {DAY}, {YEAR}",
}


def text_lines(text: str | Column) -> Column:
    """Lines without their ends; what follows the last line end only if it isn't empty."""
    t = F.col(text) if isinstance(text, str) else text
    parts = F.split(t, LINE_END)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 0), line, kind."""
    return docs.select(key, F.posexplode(text_lines(text)).alias("line_no", "line")).withColumn("kind", T.line_kind("line"))


def paragraph_blocks(text: str | Column) -> Column:
    """Runs of lines that aren't blank, each joined by line feeds. Blank lines become a mark that the text is split at."""
    marked = F.array_join(F.transform(text_lines(text), lambda x: F.when(T.strip(x) == "", F.lit("\u0001")).otherwise(x)), "\n")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda p: F.regexp_replace(p, r"^\n+|\n+$", "")), lambda p: p != "")


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.posexplode(paragraph_blocks(text)).alias("para_no", "para"))


def windows(docs: DataFrame, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All pages of `limit` characters: offset, text, returned, remaining, has_more."""
    n = F.length(text)
    starts = docs.select(key, F.col(text).alias("_t"), n.alias("total_chars"), F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(limit))).alias("offset"))
    end = F.least(F.col("offset") + limit, F.col("total_chars"))
    return starts.select(
        key, "offset", F.expr(f"substring(_t, offset + 1, {int(limit)})").alias("page_text"), (end - F.col("offset")).alias("returned_chars"),
        "total_chars", (F.col("total_chars") - end).alias("remaining_chars"), (F.col("total_chars") > end).alias("has_more"),
    )


def page(docs: DataFrame, offset: int, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One page of each document; an offset past the end is an error in the row."""
    n = F.length(text)
    past = (F.lit(offset) >= n) & ~((F.lit(offset) == 0) & (n == 0))
    error = F.when(past, F.concat(F.lit(f"offset {offset} is past the end of the document ("), n.cast("string"), F.lit(" characters)")))
    return docs.select(key, F.when(~past, F.substring(text, offset + 1, limit)).alias("page_text"), F.greatest(n - offset - limit, F.lit(0)).alias("remaining_chars"), (n > offset + limit).alias("has_more"), error.alias("error"))


def overlapping(spans: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """spans (key, chunk_id, start_char, end_char) with page_start and page_end of the pages (key, page_no, start, end) they touch."""
    s, p = spans.alias("s"), pages.alias("p")
    touch = (F.col(f"s.{key}") == F.col(f"p.{key}")) & (F.col("p.start") < F.col("s.end_char")) & (F.col("p.end") > F.col("s.start_char"))
    return s.join(p, touch).groupBy(F.col(f"s.{key}").alias(key), F.col("s.chunk_id").alias("chunk_id")).agg(F.min("p.page_no").alias("page_start"), F.max("p.page_no").alias("page_end"))


def running_lines(pages: DataFrame, doc: str, page: str, line: str, share: float = 0.6, least: int = 3) -> DataFrame:
    """doc, key, n_pages of band lines whose digit-blind key stands on many pages: max(least, int(pages * share))."""
    keyed = pages.withColumn("running_key", T.running_key(line)).where("running_key <> ''")
    counts = keyed.groupBy(doc, "running_key").agg(F.countDistinct(page).alias("n_pages"))
    totals = pages.groupBy(doc).agg(F.countDistinct(page).alias("pages"))
    return counts.join(totals, doc).where(F.col("n_pages") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select(doc, "running_key", "n_pages")


def without_running_lines(pages: DataFrame, doc: str, page: str, line: str, **options) -> DataFrame:
    noise = running_lines(pages, doc, page, line, **options).select(doc, "running_key")
    return pages.withColumn("running_key", T.running_key(line)).join(noise, [doc, "running_key"], "left_anti").drop("running_key")


def duplicate_groups(records: DataFrame, content: str, record_id: str, place: str) -> DataFrame:
    """One row per distinct content: first record, its aliases, the distinct places and the number of records.

    Lists are one content's records; use `duplicate_counts` where a content may repeat without bound.
    """
    return records.groupBy(F.sha1(F.col(content)).alias("digest")).agg(F.min(record_id).alias("first_id"), F.array_sort(F.collect_set(place)).alias("places"), F.array_sort(F.collect_list(record_id)).alias("aliases"), F.count(F.lit(1)).alias("n_records"))


def duplicate_counts(records: DataFrame, content: str, record_id: str, place: str) -> DataFrame:
    return records.groupBy(F.sha1(F.col(content)).alias("digest")).agg(F.min(record_id).alias("first_id"), F.countDistinct(place).alias("n_places"), F.count(F.lit(1)).alias("n_records"))


def is_date(v: Column) -> Column:
    parsed = F
    for f, shape in DATE_FORMATS.items():
        parsed = parsed.when(v.rlike(rf"\A{shape}\z"), F.try_to_timestamp(v, F.lit(f)))
    return parsed.isNotNull()


def column_profile(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, type (integer, float, boolean, datetime, text), null_count (blank), unique_count, from values as strings.

    One pass over the table: columns are unpivoted and grouped by value; the type is the first whose test all values pass.
    A value is tested once, after the shuffle, where the values of few large files lie in many tasks.
    """
    names = columns or table.columns
    cells = table.select(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in names])
    values = cells.unpivot([], names, "column", "value").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    v = F.when(F.col("value") != "", F.col("value"))
    test = lambda cond: F.coalesce(F.bool_and(cond), F.lit(False))
    got = values.groupBy("column").agg(
        test(v.rlike(INT)).alias("i"), test(v.rlike(FLOAT)).alias("f"), test(F.lower(v).isin("true", "false")).alias("b"), test(F.when(v.isNotNull(), is_date(v))).alias("d"),
        F.coalesce(F.sum(F.when(F.col("value") == "", F.col("n"))), F.lit(0)).alias("null_count"), F.count(v).alias("unique_count"),
    )
    kind = F.when(F.col("i"), "integer").when(F.col("f"), "float").when(F.col("b"), "boolean").when(F.col("d"), "datetime").otherwise("text")
    return got.select("column", kind.alias("type"), "null_count", "unique_count")


def json_structure(table: DataFrame, key: str, column: str) -> DataFrame:
    """key, root_type, total_keys, root_keys (first 20) of JSON strings, natively; nested counts are the reader's."""
    c = F.col(column)
    root = F.when(F.trim(c).startswith("{"), "object").when(F.trim(c).startswith("["), "array").otherwise("value")
    keys = F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))
    return table.select(key, root.alias("root_type"), F.size(keys).cast("long").alias("total_keys"), F.slice(keys, 1, 20).alias("root_keys"))


def adjacent_distances(vectors: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """group, order, distance to the vector before (none for the first)."""
    before = F.lag(vector).over(Window.partitionBy(group).orderBy(order))
    return vectors.withColumn("_before", before).where("_before IS NOT NULL").select(group, order, T.cosine_distance(F.col("_before"), F.col(vector)).alias("distance"))


def breakpoints(distances: DataFrame, group: str, order: str, method: str = "percentile", amount: float | None = None) -> DataFrame:
    """Rows whose distance exceeds the group's threshold: a percentile, mean + k standard deviations, or Q3 + k * IQR."""
    d = F.col("distance")
    if method == "percentile":
        limit = F.percentile(d, F.lit(0.5 if amount is None else amount))
    elif method == "standard_deviation":
        limit = F.avg(d) + F.stddev_pop(d) * (1.0 if amount is None else amount)
    elif method == "interquartile":
        q = lambda p: F.percentile(d, F.lit(p))
        limit = q(0.75) + (q(0.75) - q(0.25)) * (1.5 if amount is None else amount)
    else:
        raise ValueError(f"unknown method {method!r}: percentile, standard_deviation or interquartile")
    limits = distances.groupBy(group).agg(limit.alias("threshold"))
    return distances.join(limits, group).where(d > F.col("threshold")).select(group, order, "distance", "threshold")
