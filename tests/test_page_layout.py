import random

import pytest
from pyspark.sql import functions as F

from quire.operators import page_layout as L
from quire.operators import page_words as P
from quire.plans import paged

WORD = "doc_id int, page int, word_no long, text string, x0 double, y0 double, x1 double, y1 double"
RULE = "doc_id int, page int, x0 double, y0 double, x1 double, y1 double"


def random_words(spark, pages=30):
    pick = random.Random(7)
    rows = []
    for p in range(pages):
        for i in range(pick.choice([1, 5, 60])):
            text = pick.choice(["a", "Bc", "$", "....", "12", "—", "é", None if i == 3 else "x"])
            x, y = float(pick.randrange(0, 300, 3)), float(pick.randrange(0, 90, 6))
            rows.append((None if p % 5 == 4 else p // 3, p % 3, i, text, x, y, x + pick.choice([4.0, 9.5, 20.0]), y + 8))
    return spark.createDataFrame(rows, WORD)


def random_rules(spark):
    drawn = [(d, p, *e) for d in (None, 0, 1, 2, 4) for p in (0, 2) for e in ((60.5, 0.0, 61.5, 50.0), (150.0, 20.0, 150.0, 90.0), (0.0, 40.0, 300.0, 41.0), (0.0, 70.0, 300.0, 70.0), (0.0, 0.0, 300.0, 90.0))]
    return P.drawn_rules(spark.createDataFrame(drawn, RULE))


def same(got, want):
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    assert rows(got.select(*want.columns)) == rows(want)


@pytest.mark.parametrize("size", [10, 100_000])
@pytest.mark.parametrize("ruled", [True, False])
def test_one_pass_equals_the_windows(spark, monkeypatch, size, ruled):
    monkeypatch.setattr(L, "RUN", size)
    w, rules = random_words(spark), random_rules(spark) if ruled else None
    known = w.where("doc_id IS NOT NULL")  # the windows' joins don't match pages without a key
    listed = rules.where("doc_id IS NOT NULL") if ruled else None
    found = P.phrases(P.with_lines(known), rules=listed)
    placed = P.placed(found, P.columns(found)).cache()
    columns = ["doc_id", "page", "line_no", "phrase_no", "text", "x0", "y0", "x1", "y1", "n_words", "first_col", "last_col"]
    same(L.layout(known, "phrases", rules), placed.select(columns))
    same(L.layout(known, "columns", rules), P.columns(found))
    same(L.layout(known, "alignment", rules), P.alignment(placed))
    same(L.layout(known, "cells", rules), P.grid(P.merged_rows(placed)))
    same(L.layout(known, "records", rules), P.records(P.grid(P.merged_rows(placed))))
    if ruled:
        keys = ["doc_id", "page", "line_no", "phrase_no", "band", "rule_above", "rule_below"]
        apart = lambda df: df.where("(y0 + y1) / 2 NOT IN (40.5, 70)")
        same(apart(L.layout(known, "phrases", rules)).select(keys), P.with_bands(apart(placed), listed).select(keys))


def test_no_words_and_pages_without_a_key(spark):
    for what in L.SHAPES:
        assert L.layout(random_words(spark).where("text = 'none'"), what).count() == 0
        assert L.layout(spark.createDataFrame([(1, 1, 1, "a", 0.0, 0.0, 5.0, 9.0)], WORD), what).count() == (what == "phrases")
    assert L.layout(random_words(spark), "phrases").where("doc_id IS NULL").agg(F.sum("n_words")).first()[0] > 0


def test_rules_in_an_array_are_those_of_the_table(spark):
    drawn = spark.createDataFrame([(1, 1, 8.5, 0.0, 9.5, 60.0), (1, 1, 0.0, 0.0, 50.0, 50.0), (1, 1, 0.0, 5.0, 50.0, 6.0)], RULE)
    got = drawn.groupBy("doc_id").agg(F.collect_list(F.struct(*P.EDGES)).alias("d")).select(F.explode(L.rule_array(F.col("d"))).alias("r")).select("r.upright", "r.at")
    same(got, P.drawn_rules(drawn).select("upright", "at"))


@pytest.mark.parametrize("name", ["page_phrases", "page_columns", "page_placed_phrases", "page_column_alignment", "page_table_cells", "page_table_records", "page_rule_bands"])
def test_words_are_never_shuffled(spark, data, name):
    plan = getattr(paged, name)(spark, data)._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Window" not in plan and "Join" not in plan
    assert plan.index("Generate posexplode") < plan.index("Exchange hashpartitioning")


def test_boxes_meet_words_without_a_second_shuffle(spark, data):
    plan = paged.words_in_boxes(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Aggregate" not in plan
    items = spark.createDataFrame([(1, 1, 5.0, 5.0, 7.0, 7.0), (1, 1, 50.0, 5.0, 52.0, 7.0), (1, 2, 5.0, 5.0, 7.0, 7.0)], RULE)
    boxes = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 60.0, 60.0), (1, 1, 3, 0.0, 0.0, 10.0, 10.0), (1, 1, 2, 0.0, 0.0, 10.0, 10.0), (1, 1, 4, None, 0.0, 1.0, 1.0)], RULE.replace("page int", "page int, box_id int"))
    assert [(r.page, r.x0, r.box_id) for r in P.in_boxes(items, boxes).orderBy("page", "x0").collect()] == [(1, 5.0, 2), (1, 50.0, 1), (2, 5.0, None)]


def test_rows_of_one_document_are_read_together(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, "a b", "s", "en"), (2, "c", "s", "en"), (1, "d e f", "s", "en"), (3, None, "s", "en")], "doc_id long, text string, source string, lang string").repartition(4).write.parquet(f"{d}/documents.parquet")
    pages = paged.page_columns(spark, d).select("doc_id", "page", "col_no").collect()
    assert len(pages) == len(set(pages))
    assert paged.page_phrases(spark, d).agg(F.sum("n_words")).first()[0] == 6
