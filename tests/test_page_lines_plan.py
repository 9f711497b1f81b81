import pytest

from quire.operators import page_lines as PL
from quire.plans import catalog, paged


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["body_font_size", "page_noise", "page_headings", "maths_lines", "maths_regions"])
def test_texts_are_cut_once_into_lines(spark, data, name):
    """Neither again for each line, above the generator, nor where the file is read, below the exchange."""
    for line in plan(catalog.QUERIES[name](spark, data)).splitlines():
        assert "split(" not in line or "Project" in line and " AS lines#" in line, line


def test_texts_are_cut_once_into_words(spark, data):
    assert sum("split(" in line for line in plan(paged.page_words(spark, data)).splitlines()) == 1


def test_odd_lines_have_their_kind(spark):
    lines = {" a = 1 ": "formula", "": None, "   ": None, "| a = 1": None, "Dr cash": "t_account", "------": "t_account", "3*4/5": "formula", "words - here": None, "a 1 | 2": "t_account", "x=": None}
    got = spark.createDataFrame([(k,) for k in [*lines, None]], "text string").select("text", PL.line_maths().alias("k")).collect()
    assert {r.text: r.k for r in got} == lines | {None: None}
    assert [r[0] for r in spark.createDataFrame([("1+1",), ("ab",), ("",), ("a1",)], "text string").select(PL.math_density()).collect()] == [1.0, 0.0, 0.0, 0.5]
