import math

import pytest

from quire.operators import enrich
from quire.plans import catalog


def test_keyword_words_never_become_rows(spark, data):
    plan = catalog.rake_keywords(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_keywords_of_odd_texts_and_shared_keys(spark):
    d = spark.createDataFrame([(1, "big red dog"), (None, "red cat"), (2, ""), (3, None), (1, "big red dog and red ant")], "doc_id long, text string")
    got = {(r.doc_id, r.rank): (r.phrase, r.score) for r in enrich.rake(d).collect()}
    assert got == {(1, 1): ("big red dog", round(2 + 5 / 3 + 2, 6)), (1, 2): ("red ant", round(5 / 3 + 1, 6)), (None, 1): ("red cat", 2.0)}
    assert enrich.half_up(1 / 128) == 0.007813 and enrich.half_up(2 / 3) == 0.666667


def test_term_scores_move_each_text_once(spark, data):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.tfidf_scores(spark, data)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange") == 1 and "Join" not in plan and plan.count("FileScan") == 1


def test_term_scores_of_odd_chunks(spark):
    rows = [(1, 0, "red cat red"), (1, 0, "cat dog"), (1, 1, "red"), (1, 2, ""), (1, 2, None), (1, None, "dog"), (2, 0, "red"), (None, 0, "red"), (3, 0, "a the 5")]
    terms = {(1, 0): ["red", "cat", "red", "red cat", "cat red", "cat", "dog", "cat dog"], (1, 1): ["red"], (1, None): ["dog"], (2, 0): ["red"]}
    n, want = {1: 3, 2: 1}, {}
    for (doc, chunk), listed in terms.items():
        df = {t: sum(t in other for (d, _), other in terms.items() if d == doc) for t in listed}
        weights = {t: (1 + math.log(listed.count(t))) * (math.log((1 + n[doc]) / (1 + df[t])) + 1) for t in listed}
        want |= {(doc, chunk, t): round(w / math.sqrt(sum(x * x for x in weights.values())), 6) for t, w in weights.items()}
    d = spark.createDataFrame(rows, "doc long, chunk int, text string").repartition(3)
    assert {tuple(r)[:3]: r.score for r in enrich.term_scores(d, "doc", "chunk").collect()} == pytest.approx(want, abs=2e-6)
