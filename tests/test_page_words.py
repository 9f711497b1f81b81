from pyspark.sql import functions as F

from quire.operators import page_words as P

WORD = "doc_id int, page int, word_no long, text string, x0 double, y0 double, x1 double, y1 double"


def words(spark, *lines):
    """Words of lines [(text, x0), ...], 12 points apart, 6 points a character."""
    rows = [(1, 1, 100 * n + i, t, float(x), 12.0 * n, x + 6.0 * len(t), 12.0 * n + 10) for n, line in enumerate(lines) for i, (t, x) in enumerate(line)]
    return spark.createDataFrame(rows, WORD)


def texts(df):
    return [(r.line_no, r.text) for r in df.orderBy("line_no", "x0").collect()]


def table(spark, *lines):
    found = P.phrases(P.with_lines(words(spark, *lines)))
    return P.placed(found, P.columns(found))


def test_phrases_cut_at_gaps_leaders_and_rules(spark):
    w = words(spark, [("Net", 0), ("income", 20), ("$", 100), ("12", 120)], [("Notes", 0), (".....", 33), ("7", 65)], [("a", 0), ("b", 12)])
    assert texts(P.phrases(P.with_lines(w))) == [(1, "Net income"), (1, "$ 12"), (2, "Notes"), (2, "7"), (3, "a b")]
    rule = P.drawn_rules(spark.createDataFrame([(1, 1, 8.5, 0.0, 9.5, 60.0), (1, 1, 0.0, 0.0, 50.0, 50.0)], "doc_id int, page int, x0 double, y0 double, x1 double, y1 double"))
    assert rule.count() == 1
    assert texts(P.phrases(P.with_lines(w), rules=rule))[-2:] == [(3, "a"), (3, "b")]


def test_words_without_text_or_place_are_left_out(spark):
    odd = spark.createDataFrame([(1, 1, 1, None, 0.0, 0.0, 5.0, 9.0), (1, 1, 2, "x", None, 0.0, 5.0, 9.0)], WORD)
    assert P.with_lines(odd).count() == 0
    assert P.records(P.grid(P.merged_rows(table(spark, *[])))).count() == 0


def test_table_with_title_notes_and_wrapped_cells(spark):
    t = table(spark, [("Table", 0)], [("Item", 0), ("Amount", 120)], [("Rent", 0), ("paid", 120)], [("monthly", 120)], [("Food", 0), ("7", 120)], [("note", 0)])
    zones = {r.line_no: r.zone for r in P.with_zones(t).collect()}
    assert zones == {1: "title", 2: "body", 3: "body", 4: "body", 5: "body", 6: "notes"}
    got = P.records(P.grid(P.merged_rows(P.with_zones(t).where("zone = 'body'")))).first()
    assert got.rows == [["Item", "Amount"], ["Rent", "paid monthly"], ["Food", "7"]]
    assert (got.n_rows, got.n_cols) == (3, 2)


def test_spanning_cells_and_alignment(spark):
    t = table(spark, [("ab", 0), ("1", 100)], [("abcd", 0), ("123", 88)], [("heading", 0)])
    assert {r.col_no: r.align for r in P.alignment(t).collect()} == {1: "left", 2: "right"}


def test_levels_and_paths(spark):
    rows = [(1, 1, i, 1, t, x) for i, (t, x) in enumerate([("A", 0.0), ("b", 12.0), ("c", 24.0), ("d", 12.0), ("E", 0.0)])]
    got = P.with_levels(spark.createDataFrame(rows, "doc_id int, page int, row_no long, col_no long, text string, x0 double")).orderBy("row_no")
    assert [(r.level, r.path) for r in got.collect()] == [(0, ["A"]), (1, ["A", "b"]), (2, ["A", "b", "c"]), (1, ["A", "d"]), (0, ["E"])]
    shown = got.select(P.cell_text(emphasis=F.col("level") == 0).alias("t")).collect()
    assert [r.t for r in shown] == ["**A**", " b", "  c", " d", "**E**"]


def test_bands_and_nearest_rules(spark):
    t = table(spark, [("a", 0), ("b", 100)], [("c", 0), ("d", 100)])
    rules = spark.createDataFrame([(1, 1, False, 11.0)], "doc_id int, page int, upright boolean, at double")
    assert {(r.text, r.band, r.rule_above, r.rule_below) for r in P.with_bands(t, rules).collect()} == {("a", 0, None, 11.0), ("b", 0, None, 11.0), ("c", 1, 11.0, None), ("d", 1, 11.0, None)}


def test_captions_below_win_ties(spark):
    fig = spark.createDataFrame([(1, 1, 1, 0.0, 50.0, 100.0, 90.0), (1, 1, 2, 300.0, 50.0, 400.0, 90.0)], "doc_id int, page int, box_id int, x0 double, y0 double, x1 double, y1 double")
    cap = spark.createDataFrame([(1, 1, 1, "up", 0.0, 30.0, 90.0, 40.0), (1, 1, 2, "down", 0.0, 100.0, 90.0, 110.0)], "doc_id int, page int, caption_no int, text string, x0 double, y0 double, x1 double, y1 double")
    assert {r.box_id: r.caption for r in P.captioned(fig, cap).collect()} == {1: "down", 2: None}


def test_roman_numbers_and_reading_order(spark):
    rows = [(1, 1, "xiv", 50.0, 10.0), (1, 1, "abc", 0.0, 10.0), (1, 1, " ", 0.0, 0.0), (1, 1, "iiii", 0.0, 30.0)]
    df = spark.createDataFrame(rows, "doc_id int, page int, text string, x0 double, y0 double")
    assert [r.text for r in df.where(P.is_roman()).collect()] == ["xiv"]
    assert P.reading_order(df).first().text == "abc\n\nxiv\n\niiii"
