"""Phrases, columns and tables of paged documents in one pass over their words: the methods of `page_words`, page by page.

The windows of `page_words` shuffle and sort the words for each of their steps. Here a page's words come in one piece, a
task holds a run of pages, and each step is an array operation over the run: no row is shuffled, sorted or joined again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quire.operators.page_words import CURRENCY, EDGES, LEADER, PAGE

#: Words that a task works on at once; a page is never divided.
RUN = 100_000
SHAPES = {
    "phrases": "line_no bigint, phrase_no bigint, text string, x0 double, y0 double, x1 double, y1 double, n_words bigint, first_col bigint, last_col bigint, band bigint, rule_above double, rule_below double",
    "columns": "col_no bigint, x0 double, x1 double",
    "alignment": "col_no bigint, align string",
    "cells": "row_no bigint, col_no bigint, text string, x0 double, span bigint",
    "records": "n_cols int, n_rows bigint, rows array<array<string>>",
}
#: Of pages without a column.
EMPTY = {
    "cells": {"row_no": pa.int64(), "col_no": pa.int64(), "text": pa.string(), "x0": pa.float64(), "span": pa.int64()},
    "records": {"n_cols": pa.int32(), "n_rows": pa.int64(), "rows": pa.list_(pa.list_(pa.string()))},
}


def rule_array(drawings: Column, thin: float = 2.0, least: float = 10.0) -> Column:
    """`page_words.drawn_rules` for an array of drawings (structs of the four edges)."""
    level = lambda d: (d["y1"] - d["y0"] <= thin) & (d["x1"] - d["x0"] >= least)
    upright = lambda d: (d["x1"] - d["x0"] <= thin) & (d["y1"] - d["y0"] >= least)
    at = lambda d: F.when(upright(d), (d["x0"] + d["x1"]) / 2).otherwise((d["y0"] + d["y1"]) / 2)
    return F.transform(F.filter(drawings, lambda d: level(d) | upright(d)), lambda d: F.struct(upright(d).alias("upright"), at(d).alias("at"), d["y0"].alias("y0"), d["y1"].alias("y1")))


def layout(words: DataFrame, what: str, rules: DataFrame | Column | None = None, gap: float = 8.0, gutter: float = 4.0, slack: float = 0.5, whole: bool = False) -> DataFrame:
    """doc_id, page and the columns of SHAPES[what]: phrases (with their columns and bands), columns, alignment, cells or records.

    `rules` are a table as `page_words.drawn_rules` returns it, or an array column of the words (see `rule_array`), read from
    the first row of a page that has it. Edges are finite numbers; words without text or an edge are left out. `whole` says that the rows of each page already lie side by
    side in one partition; otherwise the words are shuffled by page, once.
    """
    if isinstance(rules, DataFrame):
        lists = rules.groupBy(*PAGE).agg(F.collect_list(F.struct("upright", F.col("at").cast("double").alias("at"), F.col("y0").cast("double").alias("y0") if "y0" in rules.columns else F.lit(None).cast("double").alias("y0"), F.col("y1").cast("double").alias("y1") if "y1" in rules.columns else F.lit(None).cast("double").alias("y1"))).alias("_rules"))
        words, rules, whole = words.join(lists, list(PAGE), "left"), F.col("_rules"), False
    listed = F.lit(None).cast("array<struct<upright:boolean,at:double,y0:double,y1:double>>") if rules is None else rules
    solid = words.where("text IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND y0 IS NOT NULL AND y1 IS NOT NULL")
    rows = solid.select(*PAGE, F.col("word_no").cast("long").alias("word_no"), "text", *[F.col(k).cast("double").alias(k) for k in EDGES], listed.alias("_rules"))
    if not whole:
        rows = rows.repartition(*PAGE).sortWithinPartitions(*PAGE)
    shape = S.StructType([rows.schema[k] for k in PAGE] + S.StructType.fromDDL(SHAPES[what]).fields)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            yield from laid_out(run, what, gap, gutter, slack).to_batches()

    return rows.mapInArrow(kernel, shape)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole pages, RUN words or one page each."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < RUN:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        last = np.flatnonzero(page_starts(t))[-1]
        if last:
            yield t.slice(0, last)
        t = t.slice(last)
        held, n = t.to_batches(), t.num_rows if last else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def page_starts(t: pa.Table) -> np.ndarray:
    """Whether a row's page is another than that of the row before; nulls are equal."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in PAGE:
        c = t[k].combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        differs = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(a.is_null(), b.is_null()))
        new[1:] |= differs.to_numpy(zero_copy_only=False)
    return new


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in one of the keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def counted(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sum of flags that begins anew at each start."""
    total = np.cumsum(flags)
    at = np.flatnonzero(starts)
    return total - np.repeat(total[at] - flags[at], np.diff(np.append(at, len(flags))))


def reach(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running maximum of the rows before, which begins anew at each start (-inf there); by ranks, so that it is exact."""
    kinds, rank = np.unique(values, return_inverse=True)
    group = np.cumsum(starts)
    top = np.maximum.accumulate(group * (len(kinds) + 1) + rank + 1)
    out = np.full(len(values), -np.inf)
    inner = np.flatnonzero(~starts)
    out[inner] = kinds[top[inner - 1] - group[inner] * (len(kinds) + 1) - 1]
    return out


def joined(texts: pa.Array, starts: np.ndarray) -> pa.Array:
    """One text a group of consecutive rows, joined by spaces."""
    offsets = np.append(np.flatnonzero(starts), len(starts))
    kind, index = (pa.LargeListArray, np.int64) if pa.types.is_large_string(texts.type) else (pa.ListArray, np.int32)
    return pc.binary_join(kind.from_arrays(pa.array(offsets.astype(index)), texts), " ")


def matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)


def laid_out(t: pa.Table, what: str, gap: float, gutter: float, slack: float) -> pa.Table:
    starts = page_starts(t)
    page = of_row = np.cumsum(starts) - 1
    first_row = np.flatnonzero(starts)
    col = lambda k: t[k].combine_chunks().to_numpy(zero_copy_only=False)
    no, x0, y0, x1, y1 = (col(k) for k in ("word_no", *EDGES))
    texts = t["text"].combine_chunks()

    def result(of_page: np.ndarray, **columns) -> pa.Table:
        keys = t.select(list(PAGE)).take(pa.array(first_row[of_page]))
        return pa.table({k: keys[k] for k in PAGE} | columns)

    # lines
    mid = (y0 + y1) / 2
    order = np.lexsort((no, x0, mid, page))
    m, height, begins = mid[order], (y1 - y0)[order], first_of(page[order])
    lower = begins.copy()
    lower[1:] |= np.diff(m) > height[1:] * slack
    line = np.empty(len(page), np.int64)
    line[order] = counted(lower.astype(np.int64), begins)

    # phrases
    order = np.lexsort((no, x0, line, page))
    page, line, x0, y0, x1, y1, texts = page[order], line[order], x0[order], y0[order], x1[order], y1[order], texts.take(pa.array(order))
    begins = first_of(page, line)
    end = reach(x1, begins)
    leader, sign = matches(texts, LEADER), matches(texts, CURRENCY)
    after = lambda flags: np.append(False, flags[:-1])
    ruled = np.flatnonzero(t["_rules"].combine_chunks().is_valid().to_numpy(zero_copy_only=False))
    ruled = ruled[first_of(of_row[ruled])]
    holder = np.zeros(len(first_row), np.int64)
    holder[of_row[ruled]] = ruled
    lists = t["_rules"].combine_chunks().take(pa.array(holder, mask=~np.isin(np.arange(len(first_row)), of_row[ruled])))
    size = np.where(lists.is_null(), 0, pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)
    flat = lists.flatten()
    rule = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("upright", "at", "y0", "y1")}
    of_rule, upright = np.repeat(np.arange(len(size)), size), rule["upright"].astype(bool)
    crossed = np.zeros(len(page), bool)
    for lo, n, r in placed_rules(of_rule[upright], len(size)):
        has = n[page]
        at, top, bottom = (rule[k][upright][np.minimum(lo[page] + r, max(upright.sum() - 1, 0))] for k in ("at", "y0", "y1"))
        y = (y0 + y1) / 2
        crossed |= (r < has) & (at >= end) & (at <= x0) & (y >= top) & (y <= bottom)
    cut = begins | (x0 - end > gap) & ~after(sign) | after(leader) | crossed
    kept = begins | ~leader
    page, line, x0, y0, x1, y1, begins, cut, texts = page[kept], line[kept], x0[kept], y0[kept], x1[kept], y1[kept], begins[kept], cut[kept], texts.filter(pa.array(kept))
    number = counted(cut.astype(np.int64), begins)
    at = np.flatnonzero(cut)
    words = np.diff(np.append(at, len(page)))
    least, most = (lambda v: np.minimum.reduceat(v, at)), (lambda v: np.maximum.reduceat(v, at))
    texts = joined(texts, cut)
    page, line, number, x0, y0, x1, y1 = page[at], line[at], number[at], least(x0), least(y0), most(x1), most(y1)

    # columns
    begins = first_of(page, line)
    line_at = np.flatnonzero(begins)
    in_line = np.diff(np.append(line_at, len(page)))
    body = np.repeat(in_line, in_line) > 1
    order = np.lexsort((x1[body], x0[body], page[body]))
    c_page, left, right = page[body][order], x0[body][order], x1[body][order]
    fresh = first_of(c_page)
    c_new = fresh | (left - reach(right, fresh) >= gutter)
    c_at = np.flatnonzero(c_new)
    c_no = counted(c_new.astype(np.int64), fresh)[c_at]
    c_page, left, right = c_page[c_at], left[c_at], np.maximum.reduceat(right, c_at) if len(c_at) else right
    if what == "columns":
        return result(c_page, col_no=c_no, x0=left, x1=right)
    first, last = np.zeros(len(page), np.int64), np.zeros(len(page), np.int64)
    for lo, n, r in placed_rules(c_page, len(size)):
        i = np.minimum(lo[page] + r, len(c_page) - 1)
        over = (r < n[page]) & (left[i] < x1) & (right[i] > x0)
        first = np.where(over & (first == 0), c_no[i], first)
        last = np.where(over, c_no[i], last)
    if what == "phrases":
        level = ~upright
        band, above, below = bands(of_rule[level], rule["at"][level], page, (y0 + y1) / 2)
        some = lambda v, null: pa.array(v, mask=null)
        return result(page, line_no=line, phrase_no=number, text=texts, x0=x0, y0=y0, x1=x1, y1=y1, n_words=words, first_col=some(first, first == 0), last_col=some(last, first == 0), band=band, rule_above=some(above, np.isnan(above)), rule_below=some(below, np.isnan(below)))
    if what == "alignment":
        one = np.flatnonzero((first == last) & (first > 0))
        one = one[np.lexsort((first[one], page[one]))]
        at = np.flatnonzero(first_of(page[one], first[one]))
        if not len(at):
            return result(one, col_no=first[one], align=pa.array([], pa.string()))
        spread = [np.round(np.maximum.reduceat(v, at) - np.minimum.reduceat(v, at), 6) for v in (x0[one], x1[one], ((x0 + x1) / 2)[one])]
        return result(page[one][at], col_no=first[one][at], align=pa.array(np.array(["left", "right", "center"])[np.argmin(spread, axis=0)]))

    # rows: a wrapped line continues the row above
    lead = np.minimum.reduceat(np.where(first == 0, np.iinfo(np.int64).max, first), line_at)
    placed_some = np.maximum.reduceat(first, line_at) > 0
    small = np.minimum.reduceat(matches(texts, r"^\p{Ll}").astype(np.int64), line_at) > 0
    fresh = first_of(page[line_at])
    fewer = np.append(False, in_line[1:] < in_line[:-1]) & ~fresh
    row = np.repeat(counted((~(placed_some & (lead > 1) & small & fewer)).astype(np.int64), fresh), in_line)
    cell = np.flatnonzero(first > 0)
    cell = cell[np.lexsort((number[cell], line[cell], first[cell], row[cell], page[cell]))]
    new = first_of(page[cell], row[cell], first[cell])
    at = np.flatnonzero(new)
    if not len(at):
        return result(cell, **{k: pa.array([], kind) for k, kind in EMPTY[what].items()})
    texts = joined(texts.take(pa.array(cell)), new)
    page, row, number, x0, last = page[cell][at], row[cell][at], first[cell][at], np.minimum.reduceat(x0[cell], at), np.maximum.reduceat(last[cell], at)
    if what == "cells":
        return result(page, row_no=row, col_no=number, text=texts, x0=x0, span=last - number + 1)

    # records: every row as wide as its page's table
    on_page, on_row = np.flatnonzero(first_of(page)), np.flatnonzero(first_of(page, row))
    width = np.maximum.reduceat(last, on_page)
    in_row = width[np.cumsum(first_of(page[on_row])) - 1]
    ends = np.cumsum(in_row)
    place = np.full(ends[-1], -1)
    place[(ends - in_row)[np.cumsum(first_of(page, row)) - 1] + number - 1] = np.arange(len(page))
    filled = pc.fill_null(texts.take(pa.array(place, mask=place < 0)), "")
    rows = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), filled)
    row_at = np.append(np.flatnonzero(first_of(page[on_row])), len(on_row))
    return result(page[on_page], n_cols=width.astype(np.int32), n_rows=np.diff(row_at), rows=pa.ListArray.from_arrays(pa.array(row_at.astype(np.int32)), rows))


def placed_rules(of_page: np.ndarray, pages: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For r from 0: where each page's items begin (they are sorted by page), how many it has, and r; memory stays that of the words."""
    n = np.bincount(of_page, minlength=pages) if len(of_page) else np.zeros(pages, np.int64)
    lo = np.cumsum(n) - n
    for r in range(int(n.max(initial=0))):
        yield lo, n, r


def bands(of_rule: np.ndarray, at: np.ndarray, page: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many of a page's level rules lie at y or above, the nearest of them, and the nearest below (nan: none)."""
    kinds, rank = np.unique(np.concatenate([at, y]), return_inverse=True)
    key = np.unique(of_rule * len(kinds) + rank[: len(at)])
    upto = np.searchsorted(key, page * len(kinds) + rank[len(at) :], "right")
    before, after = np.searchsorted(key, page * len(kinds)), np.searchsorted(key, (page + 1) * len(kinds))
    value = np.append(kinds[key % len(kinds)] if len(key) else [], [np.nan])
    return upto - before, np.where(upto > before, value[upto - 1], np.nan), np.where(upto < after, value[np.minimum(upto, len(key))], np.nan)
