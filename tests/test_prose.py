from quire.operators import prose


def one(spark, text, column):
    return spark.createDataFrame([(1, text)], "doc_id int, text string").select(column.alias("x")).first().x


def test_abbreviations_end_no_sentence(spark):
    got = one(spark, 'See Fig. 3 and J. Smith, e.g. here. Next one! "Done." End', prose.safe_sentences("text"))
    assert got == ["See Fig. 3 and J. Smith, e.g. here.", "Next one!", '"Done."', "End"]
    assert one(spark, "", prose.safe_sentences("text")) == []


def test_reflow(spark):
    text = "A line that\nwraps and is di-\nvided here.\n\n# Head\n- item\n```\nx =\n1\n```\n| a | b |\nend"
    got = prose.reflowed(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")).collect()
    assert {r.doc_id: r.text for r in got}[1] == "A line that wraps and is divided here.\n\n# Head\n- item\n```\nx =\n1\n```\n| a | b |\nend"
    assert 2 not in {r.doc_id for r in got}


def test_bad_cuts(spark):
    docs = spark.createDataFrame([(1, "One two. Three Dr. Four.")], "doc_id int, text string")
    pieces = spark.createDataFrame([(1, 0, "One two."), (1, 1, "Three Dr."), (1, 2, "Four.")], "doc_id int, chunk_id int, text string")
    assert [r.chunk_id for r in prose.bad_cuts(pieces, docs).collect()] == [1]


def test_list_markers(spark):
    for line, marker in [("• x", "•"), (" (a) x", "(a)"), ("iv) x", "iv)"), ("12) x", "12)"), ("3. x", "3."), ("1.2 x", None), ("-5% x", None), ("", None)]:
        got = one(spark, line, prose.list_marker("text"))
        assert (got and got.marker) == marker, line
