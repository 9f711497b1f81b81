"""Enrichment of chunk tables: measures, keywords, sections and titles. Columns in, columns out; keyword phrases alone are
scored in Python workers, a document at a time.

A chunk table has a document key, an order inside the document and a text. Everything that looks across the chunks
of a document is one shuffle on the document key.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.functions import text as T

#: Words that end a keyword phrase (fixed values: the list decides which phrases there are).
STOP_WORDS = tuple(
    """
    a about above after again against all am an and any are as at be because been before being below between both but
    by could did do does doing down during each few for from further had has have having he her here hers herself him
    himself his how i if in into is it its itself just me might more most must my myself no nor not now of off on once
    only or other our ours ourselves out over own same she should so some such than that the their theirs them
    themselves then there these they this those through to too under until up very was we were what when where which
    while who whom why will with would you your yours yourself yourselves
    """.split()
)
URL = r"\]\([^)\s]*\)|<?(?:https?|ftp)://\S+|\bwww\.\S+|\S+\.(?:svg|png|jpe?g|gif)\b"
BREAK = "\u0001"


def skipped(text: str = "text", section_type: str | None = None) -> Column:
    """Chunks that enrichment leaves alone: fewer than five words, or code."""
    short = T.word_count(text) < 5
    return short | (F.col(section_type) == "code") if section_type else short


def with_measures(chunks: DataFrame, text: str = "text") -> DataFrame:
    return chunks.withColumn("computed", T.computed(text))


def phrases(text: str = "text", stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Candidate phrases in order: runs of plain words between stop words, short words and sentence marks.

    Tokens are joined to one string in which breaks are a control character, and split there: no fold is needed.
    """
    apart = F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), "[.!?;]", BREAK), rf"[^\p{{L}}\p{{N}}_{BREAK}]+|(?<={BREAK})|(?={BREAK})", "  ")
    words = F.split(F.regexp_replace(F.concat(F.lit(" "), apart, F.lit(" ")), rf" [a-z]*[^a-z {BREAK}][^ ]* ", " "), " +")
    marked = F.array_join(F.transform(words, lambda w: F.when(w.isin(list(stop)) | ((F.length(w) < 3) & (w != "")), F.lit(BREAK)).otherwise(w)), " ")
    return F.filter(F.transform(F.split(marked, BREAK), lambda p: F.trim(p)), lambda p: p != "")


def rake(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text", top_k: int = 5) -> DataFrame:
    """key, rank, phrase, score: phrases by the summed degree/frequency of their words, four words at most.

    Ties keep the order of first appearance. One shuffle, of a document's phrases as one text; words never become rows, so
    that a task holds one key's phrases beside a batch of texts.
    """
    keys = [key] if isinstance(key, str) else list(key)
    joined = F.array_join(phrases(text), BREAK).alias("phrases")
    rows = docs.select(*keys, joined).repartition(*keys).sortWithinPartitions(*keys)
    shape = StructType([*[rows.schema[k] for k in keys], *StructType.fromDDL("rank int, phrase string, score double").fields])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = None

        def table(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [()] * (len(keys) + 3)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [*types, pa.int32(), pa.string(), pa.float64()], strict=True)], names=[*keys, "rank", "phrase", "score"])

        last, held = None, []
        for batch in batches:
            types, found = types or [batch.schema.field(k).type for k in keys], []
            for *k, listed in zip(*[batch[c].to_pylist() for c in (*keys, "phrases")], strict=True):
                if held and k != last:
                    found += [(*last, *best) for best in best_phrases(held, top_k)]
                    held = []
                last = k
                held += listed.split(BREAK) if listed else []
            if found:
                yield table(found)
        if held:
            yield table([(*last, *best) for best in best_phrases(held, top_k)])

    return rows.mapInArrow(kernel, shape)


def best_phrases(listed: list[str], top_k: int) -> list[tuple[int, str, float]]:
    """rank, phrase, score of one document's phrases, given in order and as often as they occur."""
    degree, count, first = {}, {}, {}
    for place, phrase in enumerate(listed):
        words = phrase.split(" ")
        others = len(words) - 1
        for w in words:
            degree[w] = degree.get(w, 0) + others
            count[w] = count.get(w, 0) + 1
        if others < 4 and phrase not in first:
            first[phrase] = place
    scored = ((-half_up(sum(degree[w] / count[w] for w in phrase.split(" "))), place, phrase) for phrase, place in first.items())
    return [(n, phrase, -score if score else 0.0) for n, (score, _, phrase) in enumerate(nsmallest(top_k, scored), 1)]


def half_up(x: float) -> float:
    """Six places, ties away from zero by the shortest decimal, as Spark's round has it."""
    y = x * 1e6 % 1
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) if abs(y - 0.5) < 1e-3 else round(x, 6)


def with_keywords(chunks: DataFrame, key: list[str], text: str = "text", top_k: int = 5) -> DataFrame:
    """chunks with `keywords` (array, empty for skipped chunks)."""
    best = rake(chunks.where(~skipped(text)), key, text, top_k).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank", "phrase"))).alias("_k"))
    return chunks.join(best, key, "left").withColumn("keywords", F.coalesce(F.transform("_k", lambda k: k["phrase"]), F.array().cast("array<string>"))).drop("_k")


def term_scores(chunks: DataFrame, doc: str, chunk: str, text: str = "text", stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc, chunk, term, score: TF-IDF of words and word pairs, fitted over the chunks of each document.

    1 + ln(tf), times ln((1 + n) / (1 + df)) + 1, each chunk's vector of length 1.

    One shuffle, of a chunk's tokens as one text by document. What a term's row needs of its document are windows there: a join
    by document and term would move all terms again, and so would the sums of the chunks after it. Partitions aren't merged,
    as their rows of terms are several times what was shuffled.
    """
    tokens = F.filter(F.split(F.lower(F.regexp_replace(text, URL, " ")), "[^a-z0-9_-]+"), lambda w: w.rlike("^[a-z][a-z0-9_-]+$") & ~w.isin(list(stop)))
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = chunks.where(F.col(doc).isNotNull()).select(doc, chunk, F.array_join(tokens, " ").alias("w")).repartition(parts, doc)
    inner = Window.partitionBy(doc).orderBy(chunk)
    new = F.col(chunk).isNotNull() & ~F.col(chunk).eqNullSafe(F.lag(chunk).over(inner))
    held = rows.withColumn("n", new.cast("long")).withColumn("n", F.sum("n").over(Window.partitionBy(doc))).where("w <> ''").withColumn("w", F.split("w", " "))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    tf = held.select(doc, chunk, "n", F.explode(F.concat("w", pairs)).alias("term")).groupBy(doc, chunk, "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = F.count(F.lit(1)).over(Window.partitionBy(doc, "term"))
    weight = (F.lit(1.0) + F.log("tf")) * (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    weighted = tf.withColumn("df", df).withColumn("weight", weight)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(doc, chunk)))
    return weighted.select(doc, chunk, "term", F.round(F.col("weight") / length, 6).alias("score"))


def tfidf(chunks: DataFrame, doc: str, chunk: str, text: str = "text", top_k: int = 8, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """doc, chunk, keywords: best terms first (ties by term), skipping words of a chosen pair and pairs of a chosen word."""
    ranked = term_scores(chunks, doc, chunk, text, stop).groupBy(doc, chunk).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "term"))).alias("terms"))
    covers = lambda picked, t: F.exists(picked, lambda p: F.array_contains(F.split(p, " "), t) | F.array_contains(F.split(t, " "), p))
    step = lambda picked, t: F.when((F.size(picked) >= top_k) | covers(picked, t["term"]), picked).otherwise(F.concat(picked, F.array(t["term"])))
    return ranked.select(doc, chunk, F.aggregate("terms", F.array().cast("array<string>"), step).alias("keywords"))


def with_sections(chunks: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """section_name: the last header met, or "Section 1" before any; null for skipped chunks, which don't count."""
    skip = skipped(text)
    header = F.when(~skip, T.section_header(text))
    last = F.last(header, ignorenulls=True).over(Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return chunks.withColumn("section_name", F.when(~skip, F.coalesce(last, F.lit("Section 1"))))


def with_topic_sections(chunks: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """section_name from valleys in the word overlap of neighbours ("Section n"); fewer than three chunks are one section."""
    w = Window.partitionBy(doc).orderBy(order)
    every = Window.partitionBy(doc)
    bag = F.array_distinct(F.filter(T.words(F.lower(F.col(text))), lambda x: F.length(x) > 2))
    bags = chunks.withColumn("_bag", bag).withColumn("_prev", F.lag("_bag").over(w)).withColumn("_i", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(every))
    # _sim: overlap with the chunk before; the similarity of places i-1 and i stands at row i
    some = (F.size("_bag") > 0) & (F.size("_prev") > 0)
    sims = bags.withColumn("_sim", F.when(F.col("_prev").isNull(), F.lit(None).cast("double")).when(some, T.jaccard(F.col("_prev"), F.col("_bag"))).otherwise(F.lit(0.0)))
    valley = (F.col("_sim") < F.lag("_sim").over(w)) & (F.col("_sim") < F.lead("_sim").over(w)) & (F.col("_n") >= 3)
    marked = sims.withColumn("_cut", F.coalesce(valley, F.lit(False)).cast("int"))
    number = F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)) + 1
    return marked.withColumn("section_name", F.concat(F.lit("Section "), number.cast("string"))).drop("_bag", "_prev", "_i", "_n", "_sim", "_cut")


def with_titles(chunks: DataFrame, method: str = "keywords", text: str = "text", most: int = 80) -> DataFrame:
    """Generic or missing section names replaced by titles made from the keywords or the first sentence."""
    title = T.keyword_title("keywords", text, most) if method == "keywords" else T.first_sentence_title(text, most)
    name = F.col("section_name")
    generic = name.isNull() | (name == "") | name.rlike(T.GENERIC)
    return chunks.withColumn("section_name", F.when(~skipped(text) & generic, title).otherwise(name))


def enrich(chunks: DataFrame, doc: str = "doc_id", order: str = "chunk_id", text: str = "text") -> DataFrame:
    """Keywords, sections, titles and measures, in this order."""
    out = with_keywords(chunks, [doc, order], text)
    return with_measures(with_titles(with_sections(out, doc, order, text), "keywords", text), text)
