"""Structure of paged documents from a table of their lines.

Contract (what a PDF parser supplies): doc_id, page, ordinal (reading order in the document), text, x0, y0, x1, y1,
size (points), bold, y_frac (y0 over the page's height). Everything here is aggregation and windows by document or page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

BAND = 0.10
EPSILON = 0.5
#: What is noise wherever it stands (fixed values).
BOILERPLATE = (r"(?i)^page\s+\d+\s*(of|/)\s*\d+$", r"(?i)^\d+\s*\|\s*page$", r"(?i)^page\s+\d+$", r"(?i)all rights reserved", r"(?i)^\s*(©|\(c\))\s", r"(?i)(©|\(c\))\s*\d{4}", r"(?i)^\s*confidential\s*$")
MATH_SIGNS = r"[=+×÷*/^<>≤≥±%$£€∑∫√−-]"
ABBREVIATIONS = tuple("paras. para. p.a. e.g. i.e. etc. cf. viz. Ltd. plc. Inc. Co. Corp. No. Nos. Vol. Fig. Ch. Sched. Dr. Mr. Mrs. Ms. Prof. Jan. Feb. Mar. Apr. Jun. Jul. Aug. Sep. Sept. Oct. Nov. Dec.".split())


def band(y_frac: str | Column = "y_frac") -> Column:
    y = F.col(y_frac) if isinstance(y_frac, str) else y_frac
    return F.when(y < BAND, "TOP").when(y > 1 - BAND, "BOT").otherwise("MID")


def form(text: str | Column = "text") -> Column:
    """Text without its digits' values and case."""
    t = F.col(text) if isinstance(text, str) else text
    return F.lower(T.one_line(F.regexp_replace(t, r"\d+", "#")))


def boilerplate(text: str = "text") -> Column:
    hit = F.lit(False)
    for p in BOILERPLATE:
        hit = hit | F.col(text).rlike(p)
    return hit


def with_noise(lines: DataFrame, share: float = 0.6, longest: int = 120, least: int = 3) -> DataFrame:
    """lines with `noise`: null, "boilerplate", or "running" for short band lines whose form stands on enough pages.

    Forms that run are few by definition: each stands on `least` pages or more.
    """
    banded = (band() != "MID") & (F.length("text") <= longest)
    pages = lines.groupBy("doc_id").agg(F.countDistinct("page").alias("_pages"))
    counted = lines.where(banded).groupBy("doc_id", form().alias("_form")).agg(F.countDistinct("page").alias("_on"))
    running = counted.join(pages, "doc_id").where(F.col("_on") >= F.greatest(F.lit(least), F.floor(F.col("_pages") * share))).select("doc_id", "_form", F.lit(True).alias("_runs"))
    marked = lines.withColumn("_form", F.when(banded, form())).join(running, ["doc_id", "_form"], "left")
    reason = F.when(boilerplate(), "boilerplate").when(F.col("_runs"), "running")
    return marked.withColumn("noise", reason).drop("_form", "_runs")


def noise_report(marked: DataFrame) -> DataFrame:
    """doc_id, form, reason, lines, chars of what `with_noise` marks."""
    return marked.where("noise IS NOT NULL").groupBy("doc_id", form().alias("form")).agg(F.first("noise").alias("reason"), F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


def body_sizes(lines: DataFrame) -> DataFrame:
    """doc_id, body: the size of most characters between the bands (of all lines, if there are none); the smaller of equals."""
    middle = band() == "MID"
    sums = lines.groupBy("doc_id", "size").agg(F.sum(F.when(middle, F.length("text"))).alias("mid"), F.sum(F.length("text")).alias("all"))
    best = lambda c: F.max_by("size", F.when(F.col(c).isNotNull(), F.struct(F.col(c), -F.col("size"))))
    return sums.groupBy("doc_id").agg(F.coalesce(best("mid"), best("all")).alias("body"))


def font_tiers(lines: DataFrame, ratio: float = 1.15, gap: float = 2.0, most: int = 10) -> DataFrame:
    """doc_id, size, tier: sizes above the body as heading tiers (1 the largest), rare sizes as tier 0 (titles).

    Sizes half a point apart are one; a size is rare below min(most, max(2, 5 % of the body lines)); if all are rare, the
    largest is tier 1. Sizes of one document are few, so that merging them is a fold over a short array.
    """
    bodies = body_sizes(lines)
    j = lines.join(bodies, "doc_id")
    near = j.groupBy("doc_id").agg(F.count_if(F.abs(F.col("size") - F.col("body")) <= EPSILON).alias("body_lines"))
    counts = j.where(F.col("size") > F.col("body") * ratio).groupBy("doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    listed = counts.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("sizes"))
    start = F.array().cast("array<struct<size:double,n:bigint>>")

    def merge(done, s):
        same = F.exists(done, lambda d: F.abs(d["size"] - s["size"]) <= EPSILON)
        added = F.transform(done, lambda d: F.struct(d["size"].alias("size"), F.when(F.abs(d["size"] - s["size"]) <= EPSILON, d["n"] + s["n"]).otherwise(d["n"]).alias("n")))
        return F.when(same, added).otherwise(F.concat(done, F.array(F.struct(s["size"].cast("double").alias("size"), s["n"].alias("n")))))

    merged = listed.join(near, "doc_id").select("doc_id", F.explode(F.aggregate("sizes", start, merge)).alias("s"), F.least(F.lit(most), F.greatest(F.lit(2), F.floor((F.col("body_lines") + 19) / 20))).alias("least"))
    w = Window.partitionBy("doc_id").orderBy(F.col("size").desc())
    flat = merged.select("doc_id", "s.size", "s.n", "least").withColumn("kept", F.col("n") >= F.col("least"))
    flat = flat.withColumn("any", F.max("kept").over(Window.partitionBy("doc_id"))).withColumn("rank", F.row_number().over(w))
    kept = F.when(F.col("any"), F.col("kept")).otherwise(F.col("rank") == 1)
    flat = flat.withColumn("kept", kept)
    before = F.last(F.when(F.col("kept"), F.col("size")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("kept") & (before.isNull() | (before - F.col("size") > gap)), 1).otherwise(0)
    tiers = flat.withColumn("new", new).withColumn("tier", F.when(F.col("kept"), F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).otherwise(0))
    return tiers.select("doc_id", "size", F.col("tier").cast("int").alias("tier"))


def crowded(lines: DataFrame) -> DataFrame:
    """doc_id, ordinal of lines beside a short line of the same row; a range join inside a page."""
    a, b = lines.alias("a"), lines.alias("b")
    c = lambda s, n: F.col(f"{s}.{n}")
    height = lambda s: F.greatest(c(s, "y1") - c(s, "y0"), F.lit(1e-6))
    overlap = F.least(c("a", "y1"), c("b", "y1")) - F.greatest(c("a", "y0"), c("b", "y0"))
    apart = (c("a", "x1") <= c("b", "x0")) | (c("b", "x1") <= c("a", "x0"))
    number = T.strip(c("b", "text")).rlike(r"^(?:[A-Z]|\d+)(?:\.\d+)*\.?$") & (c("b", "x1") <= c("a", "x0")) & (c("a", "x0") - c("b", "x1") < 30)
    same = (c("a", "doc_id") == c("b", "doc_id")) & (c("a", "page") == c("b", "page")) & (c("a", "ordinal") != c("b", "ordinal")) & (c("b", "y0") < c("a", "y1")) & (c("a", "y0") < c("b", "y1"))
    hit = (overlap >= 0.5 * F.least(height("a"), height("b"))) & apart & (T.word_count(c("b", "text")) <= 6) & ~number
    return a.join(b, same & hit, "left_semi").select("doc_id", "ordinal")


def headings(lines: DataFrame, ratio: float = 1.15, deepest: int = 3) -> DataFrame:
    """doc_id, ordinal, page, text, size, level (0: a title), signal (title, size, bold, numbering), heading_id."""
    text = F.col("text")
    tiers = font_tiers(lines, ratio)
    sizes = lines.select("doc_id", "size").distinct().alias("l").join(tiers.alias("t"), (F.col("l.doc_id") == F.col("t.doc_id")) & (F.abs(F.col("l.size") - F.col("t.size")) <= EPSILON))
    sizes = sizes.groupBy(F.col("l.doc_id").alias("doc_id"), F.col("l.size").alias("size")).agg(F.min("t.tier").alias("tier"))
    depth = tiers.groupBy("doc_id").agg(F.least(F.max("tier"), F.lit(deepest)).alias("depth"))
    j = lines.join(body_sizes(lines), "doc_id").join(sizes, ["doc_id", "size"], "left").join(depth, "doc_id", "left")
    j = j.join(crowded(lines).withColumn("crowded", F.lit(True)), ["doc_id", "ordinal"], "left")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    plausible = (T.word_count("text") <= 20) & ~text.rlike(r"^[\d\s.,:%()£$-]+$") & ~text.startswith("|") & (letters >= 2)
    shape = ~text.rlike(r"(?i)^(figure|fig\.|table|algorithm|listing)\s*\d+") & ~text.rlike(r"^\d+:") & ~text.rlike(r"\S+\s+\S+[^.]*\.\s+[A-Z]") & (letters >= 0.6 * F.length(F.regexp_replace(text, r"\s", "")))
    bold = F.col("bold") & (F.col("size") <= F.col("body") * ratio) & (T.word_count("text") <= 12) & ~F.rtrim(text).endswith(".") & F.col("crowded").isNull() & shape
    depth_now = F.coalesce("depth", F.lit(0))
    bold_level = F.when(depth_now > 0, F.least(depth_now + 1, F.lit(deepest))).otherwise(1)
    level = F.when(F.col("tier") == 0, 0).when(F.col("tier") <= deepest, F.col("tier")).when(bold, bold_level)
    signal = F.when(F.col("tier") == 0, "title").when(F.col("tier") <= deepest, "size").when(bold, "bold")
    number = F.regexp_extract("text", r"^(\d+(?:\.\d+)*)[.)]?\s+(\S.*)$", 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1
    numbered = (number != "") & (dots <= deepest) & (level.isNotNull() | F.col("bold") | (F.col("size") > F.col("body") * 1.05))
    out = j.where(plausible).withColumn("level", F.when(numbered, dots).otherwise(level).cast("int")).withColumn("signal", F.when(numbered, "numbering").otherwise(signal))
    identity = F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("page").cast("string"), F.col("ordinal").cast("string"), text)), 1, 12)
    return out.where("level IS NOT NULL").select("doc_id", "ordinal", "page", "text", "size", "level", "signal", identity.alias("heading_id"))


def with_heading_path(lines: DataFrame, found: DataFrame, deepest: int = 3) -> DataFrame:
    """lines with heading_path: for each level the last heading, unless a shallower one came after it."""
    marks = lines.join(found.select("doc_id", "ordinal", "level", F.col("text").alias("head")), ["doc_id", "ordinal"], "left")
    w = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    parts = []
    for k in range(1, deepest + 1):
        here = F.last(F.when(F.col("level") == k, F.struct("ordinal", "head")), ignorenulls=True).over(w)
        cut = F.max(F.when(F.col("level").between(1, k - 1), F.col("ordinal"))).over(w) if k > 1 else F.lit(None).cast("bigint")
        marks = marks.withColumn(f"_h{k}", here).withColumn(f"_c{k}", cut)
        parts.append(F.when(F.col(f"_c{k}").isNull() | (F.col(f"_h{k}.ordinal") > F.col(f"_c{k}")), F.col(f"_h{k}.head")))
    out = marks.withColumn("heading_path", F.concat_ws(" > ", *parts))
    return out.drop("level", "head", *[f"_{x}{k}" for x in "hc" for k in range(1, deepest + 1)])


def math_density(text: str | Column = "text") -> Column:
    share = lambda solid: F.when(F.length(solid) > 0, (F.length(solid) - F.length(F.regexp_replace(solid, rf"\d|{MATH_SIGNS}", ""))) / F.length(solid)).otherwise(F.lit(0.0))
    return T.let(F.regexp_replace(text, r"\s", ""), share)


def line_maths(text: str = "text", density: float = 0.3) -> Column:
    """"t_account" or "formula" of a line, else null. The line is stripped once, and what few lines meet is asked first."""
    sign = F.col(text).rlike(MATH_SIGNS)

    def kind(t: Column) -> Column:
        formula = (t != "") & ~t.startswith("|") & sign & (t.rlike(r"^[A-Za-z][\w\s()'-]{0,40}=\s*\S") | t.rlike(r"\d") & (math_density(text) >= density))
        ruled = t.rlike(r"^[\s\-_=|+]{6,}$")
        sides = t.contains("|") & ~t.startswith("|") & t.rlike(r"^[^|]*\d[^|]*\|.*\d")
        account = (t != "") & (ruled | t.rlike(r"\b(Dr|Cr|Debit|Credit)\b") & (T.word_count(t) <= 12) | sides)
        return F.when(account, "t_account").when(formula, "formula")

    return T.let(T.strip(text), kind)


def math_regions(lines: DataFrame) -> DataFrame:
    """doc_id, page, start_ordinal, end_ordinal, kind, line_count: runs of maths lines on a page (gaps and islands)."""
    w = Window.partitionBy("doc_id").orderBy("ordinal")
    marked = lines.withColumn("kind", line_maths()).withColumn("_prev", F.lag("kind").over(w)).withColumn("_page", F.lag("page").over(w))
    begins = F.col("kind").isNotNull() & (F.col("_prev").isNull() | (F.col("_page") != F.col("page")))
    runs = marked.withColumn("_run", F.sum(begins.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("kind IS NOT NULL")
    out = runs.groupBy("doc_id", "_run").agg(F.min("page").alias("page"), F.min("ordinal").alias("start_ordinal"), F.max("ordinal").alias("end_ordinal"), F.max("kind").alias("kind"), F.count(F.lit(1)).alias("line_count"))
    return out.drop("_run")


def ends_mid_sentence(text: str = "text") -> Column:
    """Whether text looks like prose that breaks off: judged on its last line, without trailing numbers and marks."""
    last = T.strip(F.substring_index(F.regexp_replace(text, r"\s+$", ""), "\n", -1))
    bare = F.regexp_replace(last, r"[\s\d✓✔✗✘○●•]+$", "")
    whole = last.rlike(r"^(\||```|#|>)") | last.rlike(r"^([-*+•]|\d+[.)])\s") | last.rlike("[:;]$") | bare.rlike("[:;]$") | (bare == "") | bare.rlike(r"^[\d\s.,)(]+$") | (T.word_count(bare) <= 3) | (F.length(F.regexp_replace(bare, r"[^\p{L}]", "")) < 2)
    short = F.lit(False)
    for a in ABBREVIATIONS:
        short = short | bare.endswith(a)
    return F.when(whole, F.lit(False)).otherwise(~bare.rlike("[.!?\"')\\]…]$") | short)
