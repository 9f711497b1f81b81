"""Lines, phrases, columns and tables of paged documents, from a table of their words.

Contract (what a PDF parser supplies): words are doc_id, page, word_no, text, x0, y0, x1, y1 in points, y downwards, and
may carry size and bold. Boxes (tables, cells, figures) are doc_id, page, box_id and the same four edges. Everything is
windows and aggregation by (doc_id, page), so that a page is the largest unit that one task has to hold; only what
follows a table from page to page is by document, over one row a table.

Null text or a null edge takes a word out of its line; further columns are dropped by what aggregates and kept by the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page")
EDGES = ("x0", "y0", "x1", "y1")
#: Signs that stand alone before an amount (fixed values).
CURRENCY = r"^[$£€¥₹]$"
LEADER = r"^[.·…_]{3,}$"
NUMERIC = r"^[(+\-−]?[$£€¥₹]?\s?\d[\d,.\s]*%?\)?$"
ROMAN = r"(?i)^(?=[ivxlcdm])m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$"
EM_SPACE = " "


def drawn_rules(drawings: DataFrame, thin: float = 2.0, least: float = 10.0) -> DataFrame:
    """Drawings (lines, or rectangles at most `thin` thick) that are rules: with `upright` and `at` (their place across)."""
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    level, upright = (height <= thin) & (width >= least), (width <= thin) & (height >= least)
    at = F.when(upright, (F.col("x0") + F.col("x1")) / 2).otherwise((F.col("y0") + F.col("y1")) / 2)
    return drawings.where(level | upright).withColumn("upright", upright).withColumn("at", at)


def in_boxes(items: DataFrame, boxes: DataFrame | Column) -> DataFrame:
    """items with the box_id that their centre lies in (the smallest box, then the least id; null if none); lines in tables
    and words in cells alike.

    `boxes` are a table, whose rows of a page are joined to its items as one array, or such an array column of the items
    (structs of box_id and the four edges): an item meets its page's boxes in its own row, and nothing is grouped again.
    """
    rows = items
    if isinstance(boxes, DataFrame):
        listed = boxes.groupBy(*PAGE).agg(F.collect_list(F.struct("box_id", *EDGES)).alias("_boxes"))
        rows, boxes = items.join(listed, list(PAGE), "left"), F.col("_boxes")
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    around = F.filter(boxes, lambda b: x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"]))
    sized = F.transform(around, lambda b: F.struct(((b["x1"] - b["x0"]) * (b["y1"] - b["y0"])).alias("area"), b["box_id"].alias("box_id")))
    return rows.select(*items.columns, F.array_min(sized)["box_id"].alias("box_id"))


def with_lines(words: DataFrame, slack: float = 0.5) -> DataFrame:
    """words with line_no (from 1, top to bottom): a line ends where the next centre is lower by `slack` of a word's height."""
    mid = (F.col("y0") + F.col("y1")) / 2
    w = Window.partitionBy(*PAGE).orderBy("_mid", "x0", "word_no")
    solid = words.where("text IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL").withColumn("_mid", mid)
    new = F.coalesce((F.col("_mid") - F.lag("_mid").over(w) > (F.col("y1") - F.col("y0")) * slack).cast("int"), F.lit(1))
    return solid.withColumn("_new", new).withColumn("line_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_mid", "_new")


def phrases(lined: DataFrame, gap: float = 8.0, rules: DataFrame | None = None) -> DataFrame:
    """One row a phrase: words of a line up to a wide gap, a dot leader or an upright rule; a lone currency sign stays
    with the amount after it. doc_id, page, line_no, phrase_no (from 1), text, edges, n_words.

    `rules` (see `drawn_rules`) are joined on the page to the places between two words; at most one row comes back for each.
    """
    line = Window.partitionBy(*PAGE, "line_no").orderBy("x0", "word_no")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    rows = lined.withColumn("_end", F.max("x1").over(before)).withColumn("_last", F.lag("text").over(line))
    cut = (F.col("x0") - F.col("_end") > gap) & ~F.col("_last").rlike(CURRENCY) | F.col("_last").rlike(LEADER)
    if rules is not None:
        r = rules.where("upright").select(*[F.col(k).alias(f"_{k}") for k in PAGE], F.col("at").alias("_at"), F.col("y0").alias("_top"), F.col("y1").alias("_bottom"))
        y = (F.col("y0") + F.col("y1")) / 2
        crossed = (F.col("doc_id") == F.col("_doc_id")) & (F.col("page") == F.col("_page")) & (F.col("_at") >= F.col("_end")) & (F.col("_at") <= F.col("x0")) & y.between(F.col("_top"), F.col("_bottom"))
        ruled = rows.where("_end IS NOT NULL").join(r, crossed, "left_semi").select(*PAGE, "line_no", "word_no", F.lit(True).alias("_ruled"))
        rows = rows.join(ruled, [*PAGE, "line_no", "word_no"], "left")
        cut = cut | F.coalesce("_ruled", F.lit(False))
    rows = rows.withColumn("_new", F.coalesce(cut.cast("int"), F.lit(1))).where(~F.col("text").rlike(LEADER) | F.col("_end").isNull())
    numbered = rows.withColumn("phrase_no", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_no", "text"))), lambda w: w["text"]), " ")
    edges = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
    return numbered.groupBy(*PAGE, "line_no", "phrase_no").agg(joined.alias("text"), *edges, F.count(F.lit(1)).alias("n_words"))


def columns(found: DataFrame, gap: float = 4.0) -> DataFrame:
    """col_no (from 1), x0, x1 of each page's columns: stretches that phrases of its body cover, with white space between.

    Body lines are those with two phrases or more; a lone phrase may span all columns and says nothing about them.
    """
    body = found.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "line_no"))).where("_n > 1")
    w = Window.partitionBy(*PAGE).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = body.select(*PAGE, "x0", "x1").distinct().withColumn("_new", F.coalesce((F.col("x0") - reach >= gap).cast("int"), F.lit(1)))
    return marked.withColumn("col_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*PAGE, "col_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))


def placed(found: DataFrame, cols: DataFrame) -> DataFrame:
    """found with first_col and last_col, the columns that a phrase overlaps (null: none)."""
    c = cols.select(*PAGE, "col_no", F.col("x0").alias("_left"), F.col("x1").alias("_right"))
    over = found.select(*PAGE, "line_no", "phrase_no", "x0", "x1").join(c, list(PAGE)).where("_left < x1 AND _right > x0")
    spans = over.groupBy(*PAGE, "line_no", "phrase_no").agg(F.min("col_no").alias("first_col"), F.max("col_no").alias("last_col"))
    return found.join(spans, [*PAGE, "line_no", "phrase_no"], "left")


def alignment(cells: DataFrame) -> DataFrame:
    """doc_id, page, col_no, align: of left edge, right edge and centre, the one that varies least (ties in this order)."""
    mid = (F.col("x0") + F.col("x1")) / 2
    spread = cells.where("first_col = last_col").groupBy(*PAGE, F.col("first_col").alias("col_no")).agg(*[F.round(F.max(c) - F.min(c), 6).alias(n) for n, c in (("l", F.col("x0")), ("r", F.col("x1")), ("c", mid))])
    best = F.least("l", "r", "c")
    return spread.select(*PAGE, "col_no", F.when(F.col("l") == best, "left").when(F.col("r") == best, "right").otherwise("center").alias("align"))


def with_zones(cells: DataFrame) -> DataFrame:
    """cells with zone: "title" and "notes" are lone phrases above and below the lines of several, the rest is "body"."""
    page = Window.partitionBy(*PAGE)
    several = F.count(F.lit(1)).over(Window.partitionBy(*PAGE, "line_no")) > 1
    rows = cells.withColumn("_several", several).withColumn("_top", F.min(F.when(F.col("_several"), F.col("line_no"))).over(page)).withColumn("_end", F.max(F.when(F.col("_several"), F.col("line_no"))).over(page))
    zone = F.when(F.col("line_no") < F.col("_top"), "title").when(F.col("line_no") > F.col("_end"), "notes").otherwise("body")
    return rows.withColumn("zone", zone).drop("_several", "_top", "_end")


def with_bands(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """cells with band (how many level rules lie above their centre), rule_above and rule_below (the nearest ones' y).

    Rules and cells are merged and read off by running aggregates, so a page of many rules makes no pairs.
    """
    y = (F.col("y0") + F.col("y1")) / 2
    shape = dict(cells.dtypes)
    marks = rules.where("NOT upright").select(*PAGE, "at").distinct().select(*PAGE, F.col("at").alias("_y"), F.col("at").alias("_rule"), *[F.lit(None).cast(shape[c]).alias(c) for c in cells.columns if c not in PAGE])
    rows = cells.withColumn("_y", y).withColumn("_rule", F.lit(None).cast("double")).unionByName(marks)
    w = Window.partitionBy(*PAGE).orderBy("_y", F.col("_rule").asc_nulls_last())
    up, down = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = rows.withColumn("band", F.count("_rule").over(up)).withColumn("rule_above", F.last("_rule", True).over(up)).withColumn("rule_below", F.first("_rule", True).over(down))
    return out.where("line_no IS NOT NULL").drop("_y", "_rule")


def merged_rows(cells: DataFrame) -> DataFrame:
    """cells with row_no: a line continues the row above if its first column is empty, it has fewer cells, and every cell
    starts with a small letter (a wrapped cell); otherwise it is a row."""
    lines = cells.groupBy(*PAGE, "line_no").agg(F.min("first_col").alias("_lead"), F.count(F.lit(1)).alias("_n"), F.bool_and(F.col("text").rlike(r"^\p{Ll}")).alias("_small"))
    w = Window.partitionBy(*PAGE).orderBy("line_no")
    wraps = (F.col("_lead") > 1) & F.col("_small") & (F.col("_n") < F.lag("_n").over(w))
    rows = lines.withColumn("row_no", F.sum(F.when(F.coalesce(wraps, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return cells.join(rows.select(*PAGE, "line_no", "row_no"), [*PAGE, "line_no"])


def grid(rows: DataFrame) -> DataFrame:
    """doc_id, page, row_no, col_no, text, x0, span: one row a cell; wrapped lines and phrases of a cell joined by a space."""
    parts = F.array_sort(F.collect_list(F.struct("line_no", "phrase_no", "text")))
    return rows.where("first_col IS NOT NULL").groupBy(*PAGE, "row_no", F.col("first_col").alias("col_no")).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"), F.min("x0").alias("x0"), (F.max("last_col") - F.first("first_col") + 1).alias("span"))


def with_levels(cells: DataFrame, step: float = 3.0) -> DataFrame:
    """The grid's first cells of each row with level (0 for the leftmost) and path (the row's ancestors and itself).

    Levels are places of left edges, rounded to `step` points; an ancestor is the last row before of each lower level that
    no row of a still lower level has come after. Levels of a page are few, so its path is an array as wide as they are.
    """
    stub = cells.where("col_no = 1")
    page = Window.partitionBy(*PAGE)
    level = F.dense_rank().over(page.orderBy("_left")) - 1
    rows = stub.withColumn("_left", F.round(F.col("x0") / step)).withColumn("level", level)
    w = page.orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.collect_list(F.struct("row_no", "level", "text")).over(w)
    low = lambda kept, r: F.concat(F.filter(kept, lambda k: k["level"] < r["level"]), F.array(r))
    kind = "array<struct<row_no:bigint,level:int,text:string>>"
    return rows.withColumn("path", F.transform(F.aggregate(seen, F.array().cast(kind), lambda kept, r: low(kept, r).cast(kind)), lambda r: r["text"])).drop("_left")


def cell_text(text: str = "text", level: str = "level", emphasis: Column | None = None) -> Column:
    """A stub cell as shown: an em space a level, bold for group and total rows."""
    shown = F.when(emphasis, F.concat(F.lit("**"), F.col(text), F.lit("**"))).otherwise(F.col(text)) if emphasis is not None else F.col(text)
    return F.concat(F.repeat(F.lit(EM_SPACE), F.col(level)), shown)


def records(cells: DataFrame) -> DataFrame:
    """One row a page's table: n_rows, n_cols, rows (arrays of cell strings in order, empty where no cell is)."""
    width = F.max(F.col("col_no") + F.col("span") - 1).over(Window.partitionBy(*PAGE)).cast("int")
    lines = cells.withColumn("n_cols", width).groupBy(*PAGE, "row_no", "n_cols").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col_no").cast("int"), "text"))).alias("m"))
    full = lines.withColumn("cells", F.transform(F.sequence(F.lit(1), "n_cols"), lambda c: F.coalesce(F.col("m")[c], F.lit(""))))
    table = F.array_sort(F.collect_list(F.struct("row_no", "cells")))
    return full.groupBy(*PAGE, "n_cols").agg(F.count(F.lit(1)).alias("n_rows"), F.transform(table, lambda r: r["cells"]).alias("rows"))


def continued(tables: DataFrame, top: float = 0.2, bottom: float = 0.8) -> DataFrame:
    """tables (doc_id, page, table_no, n_cols, top, bottom as shares of the page, header) with group_no and the header
    that they carry on: a table at the head of a page continues the one that ended at the foot of the page before, if it
    has as many columns and no header of its own."""
    w = Window.partitionBy("doc_id").orderBy("page", "top", "table_no")
    last = lambda c: F.lag(c).over(w)
    joins = F.col("header").isNull() & (F.col("page") == last("page") + 1) & (F.col("n_cols") == last("n_cols")) & (F.col("top") <= top) & (last("bottom") >= bottom)
    grouped = tables.withColumn("group_no", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.withColumn("header", F.first("header").over(Window.partitionBy("doc_id", "group_no").orderBy("page", "top", "table_no")))


def captioned(figures: DataFrame, captions: DataFrame, reach: float = 60.0) -> DataFrame:
    """figures (boxes) with the caption (doc_id, page, caption_no, text, edges) nearest above or below, within `reach`:
    overlapping across first needed, then the nearer, then the one below, then the least number. Null if there is none."""
    c = captions.select(*[F.col(k).alias(f"_{k}") for k in (*PAGE, *EDGES)], "caption_no", F.col("text").alias("caption"))
    below, above = F.col("_y0") - F.col("y1"), F.col("y0") - F.col("_y1")
    away = F.greatest(below, above, F.lit(0.0))
    near = (F.col("doc_id") == F.col("_doc_id")) & (F.col("page") == F.col("_page")) & (F.col("_x0") < F.col("x1")) & (F.col("_x1") > F.col("x0")) & (away <= reach)
    best = F.min_by(F.struct("caption_no", "caption"), F.struct(F.round(away, 6), (below < above).cast("int"), F.col("caption_no")))
    return figures.join(c, near, "left").groupBy(*PAGE, "box_id").agg(best.alias("_c")).select(*PAGE, "box_id", "_c.caption_no", "_c.caption")


def repeated_images(images: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """doc_id, digest, n_pages of images on `least` pages or more and on more than `share` of the document's: logos."""
    pages = images.groupBy("doc_id").agg(F.max("page_count").alias("pages"))
    on = images.where("digest IS NOT NULL").groupBy("doc_id", "digest").agg(F.countDistinct("page").alias("n_pages"))
    return on.join(pages, "doc_id").where((F.col("n_pages") >= least) & (F.col("n_pages") > F.col("pages") * share)).select("doc_id", "digest", "n_pages")


def is_roman(text: str = "text") -> Column:
    return F.trim(text).rlike(ROMAN)


def reading_order(blocks: DataFrame) -> DataFrame:
    """One row a page: its blocks' texts, top to bottom and left to right, joined by empty lines."""
    order = F.array_sort(F.collect_list(F.struct(F.round("y0", 1).alias("y"), "x0", "text")))
    return blocks.where("trim(coalesce(text, '')) <> ''").groupBy(*PAGE).agg(F.array_join(F.transform(order, lambda b: F.trim(b["text"])), "\n\n").alias("text"))
