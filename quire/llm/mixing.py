"""Mixing sources to target weights by entropy balancing, with DataFrame operations only.

Each source has a token target. Document rates are tilted exponentially in the document's size,
    rate = most / (1 + exp(-lambda * size / scale)),
the solution of the bounded entropy problem whose only constraint is the source's token sum; lambda = 0 leaves a rate
of 1 when most is 2. Its dual is convex in lambda, and Newton iterations (kept inside a bracket) solve it for all sources
at once over the histogram (source, size, count), which is far smaller than the documents. Rates become copies by
systematic rounding over sizes in descending order, a last fold over small sizes removes what is left of the
residual, and each cell's copies are dealt to its documents by hash.

All sums that decide are exact decimals or integers, so that reruns agree whatever the order of rows.

Defined results: a null text has size 0; documents of size 0 take no words and count one copy; a null source is a source
of its own, last in order; rows that share a doc_id are rows like any other; an empty table gives no rows; a source
without words has the target 0. Hot cells (a source's copies of one text) are dealt in 64 parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import WORD, free, salt, staged

BUCKETS = 64
#: Sizes that the last fold may change: it holds at most that many entries a source.
SMALL = 1024
EDGE = 1e-7


def word_count(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, key, size, n_points, bucket: one pass over the texts, without a shuffle."""
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    return docs.select("doc_id", "source", key.alias("key"), word_count().alias("size"), F.coalesce(F.length("text"), F.lit(-1)).alias("n_points"), salt(["doc_id"], BUCKETS).alias("bucket"))


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """key, source_size, n_docs, target: the weights' shares of share * all sizes, filled up to most * the source's size.

    The windows below have one row for each source, in one task: they fit sources that are collections, up to some
    millions, not ones that grow with the documents.
    """
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    ranked = sources.select("*", rank.alias("rank"), weight.alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    filled = ranked.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("weight") * F.col("level"))
    water = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)
    return filled.select("key", "source_size", "n_docs", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * water).alias("target"))


def rate(most: float) -> Column:
    """The tilted rate of a document of `size` under the state's lambda; null lambda means that all of it is wanted."""
    return F.when(F.col("lam").isNull(), F.lit(most)).otherwise(F.lit(most) / (F.lit(1.0) + F.exp(-F.col("lam") * F.col("size") / F.col("scale"))))


def solve(cells: DataFrame, goals: DataFrame, most: float, rounds: int = 60, near: float = 1e-6) -> DataFrame:
    """goals with scale and lam. A round is one aggregation of the cells; each ends in a table with one row a source."""
    full = F.col("target") >= F.col("source_size") * F.lit(most * (1 - EDGE))
    state = goals.where("source_size > 0").select(
        "*",
        (F.col("source_size") / F.col("n_docs")).alias("scale"),
        F.when(~full, F.lit(0.0)).alias("lam"),
        F.lit(-512.0).alias("low"),
        F.lit(512.0).alias("high"),
        full.alias("done"),
    )
    held = state = staged(state, "mix-state")
    exact = lambda c: F.sum(c.cast("decimal(30,6)"))
    for _ in range(rounds):
        if state.where("NOT done").isEmpty():
            break
        r = rate(most)
        mass = F.col("n") * F.col("size")
        sums = cells.join(state.where("NOT done").select("key", "lam", "scale"), "key").groupBy("key").agg(
            exact(mass * r).alias("got"), exact(mass * F.col("size") / F.col("scale") * r * (F.lit(1.0) - r / F.lit(most))).alias("slope")
        )
        over = F.col("got").cast("double") - F.col("target")
        step = state.join(sums, "key", "left").withColumn("over", over)
        step = step.withColumn("high", F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("high"))).withColumn("low", F.when(F.col("over") <= 0, F.col("lam")).otherwise(F.col("low")))
        newton = F.col("lam") - F.col("over") / F.col("slope").cast("double")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        found = F.abs(F.col("over")) <= F.col("target") * F.lit(near)
        moved = F.when(found, F.col("lam")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        stuck = F.col("high") - F.col("low") < 1e-12
        state = step.select(
            "key", "source_size", "n_docs", "target", "scale",
            F.when(F.col("done"), F.col("lam")).otherwise(moved).alias("lam"),
            "low", "high", (F.col("done") | found | stuck).alias("done"),
        )
        last, state = held, staged(state, "mix-state")
        free(last)
        held = state
    return state


def cell_copies(cells: DataFrame, state: DataFrame, most: float) -> DataFrame:
    """key, size, n, copies of the cell's documents in all."""
    down = Window.partitionBy("key").orderBy(F.col("size").desc())
    dealt = cells.join(state.select("key", "target", "lam", "scale"), "key").withColumn("want", F.col("n") * rate(most))
    through = F.sum("want").over(down.rowsBetween(Window.unboundedPreceding, 0))
    before = F.coalesce(F.sum("want").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    dealt = dealt.withColumn("copies", F.floor(through + 0.5) - F.floor(before + 0.5)).withColumn("copies", F.least(F.greatest("copies", F.lit(0)), (F.col("n") * int(most))))
    dealt = staged(dealt.select("key", "target", "size", "n", "copies"), "mix-cells")
    small = F.when(F.col("size") <= SMALL, F.struct("size", "n", "copies"))
    rest = dealt.groupBy("key").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("rest"), F.sort_array(F.collect_list(small), asc=False).alias("small"))

    def settle(state, cell):
        room = cell["n"] * int(most) - cell["copies"]
        whole = F.floor(F.abs(state["rest"]) / cell["size"])
        change = F.when(state["rest"] > 0, F.least(room, whole)).otherwise(-F.least(cell["copies"], whole))
        made = F.array(F.struct(cell["size"].alias("size"), (cell["copies"] + change).cast("long").alias("copies")))
        return F.struct((state["rest"] - change * cell["size"]).alias("rest"), F.concat(state["made"], made).alias("made"))

    start = F.struct(F.col("rest").cast("double").alias("rest"), F.array().cast("array<struct<size:bigint,copies:bigint>>").alias("made"))
    settled = rest.select("key", F.explode(F.aggregate("small", start, settle)["made"]).alias("m")).select("key", "m.size", F.col("m.copies").alias("settled"))
    return dealt.join(settled, ["key", "size"], "left").select("key", "size", "n", F.coalesce("settled", "copies").alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, n_points, size, source_size, target, copies, taken: one row per row of docs."""
    sizes = staged(measured(docs), "mix-sizes")
    parts = staged(sizes.where("size > 0").groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-parts")
    goals = staged(targets(sizes, weights, share, most), "mix-goals")
    cells = staged(parts.groupBy("key", "size").agg(F.sum("n").alias("n")), "mix-hist")
    state = solve(cells, goals, most)
    copies = cell_copies(cells, state, most)
    upto = Window.partitionBy("key", "size").orderBy("bucket")
    ends = F.sum("n").over(upto.rowsBetween(Window.unboundedPreceding, 0)).cast("decimal(18,0)")
    shared = parts.join(copies.withColumnRenamed("n", "total"), ["key", "size"]).withColumn("ends", ends)
    below = F.expr("cast(floor((cast(copies as decimal(18,0)) * (ends - n)) / total) as bigint)")
    shared = shared.withColumn("mine", F.expr("cast(floor((cast(copies as decimal(18,0)) * ends) / total) as bigint)") - below)
    shared = shared.select("key", "size", "bucket", F.expr("mine div n").alias("each"), F.expr("mine % n").alias("more"))
    placed = Window.partitionBy("key", "size", "bucket").orderBy(F.xxhash64("doc_id", "key"), "doc_id")
    rows = sizes.join(shared, ["key", "size", "bucket"], "left").withColumn("place", F.row_number().over(placed))
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("each") + (F.col("place") <= F.col("more")).cast("long")))
    out = rows.join(goals.select("key", "source_size", "target"), "key")
    return out.select("doc_id", "source", "n_points", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows, each as often as its copies say. Rows that share a doc_id are told apart by source,
    size and length, then by place among alike rows, which may swap copies without changing any sum."""
    same = lambda size, points: Window.partitionBy("doc_id").orderBy(F.col("source").asc_nulls_first(), size, points)
    plan = mix_sources(docs, **options).select("doc_id", "copies", F.row_number().over(same("size", "n_points")).alias("place"))
    rows = docs.withColumn("__place", F.row_number().over(same(word_count(), F.coalesce(F.length("text"), F.lit(-1)))))
    joined = rows.alias("r").join(plan.alias("p"), F.col("r.doc_id").eqNullSafe(F.col("p.doc_id")) & (F.col("r.__place") == F.col("p.place")))
    copied = joined.where("p.copies > 0").select(*[F.col(f"r.`{c}`").alias(c) for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("p.copies").cast("int"))).alias("__copy"))
    return copied.drop("__copy")
