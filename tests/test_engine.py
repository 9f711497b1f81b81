"""Expressions, enrichment, rendering, structure and watching on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quire import api
from quire.functions import text as T
from quire.operators import chunking, enrich, render, structure
from quire.session import table
from quire.streaming import watch


def one(spark, expr, *values, names="abc"):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n, _ in zip(names, values, strict=False)))
    return row.select(expr.alias("v")).collect()[0]["v"]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ALL CAPS HEAD\nbody", "All Caps Head"), ("Ends so:\nx", "Ends so"), ("1.2. Numbered part", "Numbered part"), ("**Bold start** and on", "Bold start"), ("_Slanted_ text", "Slanted"),
        ("just a line", None), ("", None), ("O'NEIL-SMITH", "O'Neil-Smith"), (" ".join("w" * 16) + ":", None),
    ],
)
def test_section_headers(spark, text, want):
    assert one(spark, T.section_header("a"), text) == want


def test_word_counts_follow_unicode_spaces(spark):
    s = "a b\x1cc\u0085d　e \x0b f"
    assert one(spark, T.word_count("a"), s) == len(s.split()) == 6
    assert one(spark, T.word_count("a"), "") == 0


def test_measures(spark):
    assert one(spark, T.complexity_score("a"), "") == 50.0
    assert one(spark, T.reading_time("a"), "w " * 450) == "2 min"
    assert one(spark, T.avg_word_length("a"), "Hello, you!") == 4.0
    assert one(spark, T.human_size("a"), "1536") == "1.5 KB"
    assert one(spark, T.slug("a"), "A b-C, d!") == "a_b_c_d"
    assert one(spark, T.file_name("a"), "x/y\\z.txt") == "z.txt"
    assert one(spark, T.first_sentence_title("a"), "A first one, here. Then more.") == "A first one, here"
    assert one(spark, T.running_key("a"), "**Page 12** of  9") == "page # of #"
    assert one(spark, T.sentences("a"), "One. Two!  Three") == ["One.", "Two!", "Three"]


def test_rake_ranks_phrases(spark):
    docs = spark.createDataFrame([(1, "Deep learning models beat the shallow models. Deep learning is fun; big blue deep learning models")], "doc_id long, text string")
    got = [(r["phrase"], r["score"]) for r in enrich.rake(docs).orderBy("rank").collect()]
    assert got[0][0] == "deep learning models beat" or got[0][0] == "big blue deep learning models"
    assert all(len(p.split()) <= 4 for p, _ in got) and [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def chunk_rows(spark):
    rows = [(1, 0, "INTRO PART\nsome plain words follow here"), (1, 1, "more plain words without any header"), (1, 2, "tiny"), (2, 0, "nothing special about this very chunk")]
    return spark.createDataFrame(rows, "doc_id long, chunk_id int, text string")


def test_sections_carry_on(spark):
    got = {(r["doc_id"], r["chunk_id"]): r["section_name"] for r in enrich.with_sections(chunk_rows(spark), "doc_id", "chunk_id").collect()}
    assert got == {(1, 0): "Intro Part", (1, 1): "Intro Part", (1, 2): None, (2, 0): "Section 1"}


def test_enrich_and_render(spark):
    c = enrich.enrich(chunk_rows(spark))
    rows = {(r["doc_id"], r["chunk_id"]): r for r in c.collect()}
    assert rows[2, 0]["section_name"].startswith("Section: ") and rows[1, 2]["keywords"] == [] and rows[1, 0]["computed"]["word_count"] == 7
    text = {r["doc_id"]: r["rendered"] for r in render.compact_documents(c).collect()}
    assert text[1].startswith("d:1|t:unknown|w:14|n:3\n---\n0|0-39|text|Intro Part\nINTRO PART\n")
    assert json.loads(render.json_documents(c).where("doc_id = 1").collect()[0]["json"])["total_chunks"] == 3
    kinds = [r["kind"] for r in render.graph_edges(c).where("from_node like '1%'").collect()]
    assert kinds.count("PART_OF") == 3 and kinds.count("CONTAINS") == kinds.count("HAS_SECTION") == 2
    assert render.graph_nodes(c).where("label = 'Section'").count() == 3
    assert render.vector_objects(c).count() == 4
    assert "<text>tiny</text>" in render.xml_chunks(c).where("doc_id = 1").collect()[0]["xml"]
    assert one(spark, render.xml_tag("a"), "1 b") == "_1_b"


def test_compact_is_much_shorter_than_json(spark):
    rows = [(1, i, "Some words of a chunk that says a few things. " * 3) for i in range(5)]
    c = enrich.enrich(spark.createDataFrame(rows, "doc_id long, chunk_id int, text string"))
    compact = render.compact_documents(c).collect()[0]["rendered"]
    full = json.dumps(json.loads(render.json_documents(c).collect()[0]["json"]), indent=2)
    assert len(compact) < 0.7 * len(full)


def test_tfidf_skips_covered_terms(spark):
    rows = [(1, 0, "solar panel solar panel output rises"), (1, 1, "wind turbine output rises")]
    got = {r["chunk_id"]: r["keywords"] for r in enrich.tfidf(spark.createDataFrame(rows, "doc_id long, chunk_id int, text string"), "doc_id", "chunk_id").collect()}
    assert any(k in got[0] for k in ("solar", "solar panel")) and not {"solar", "solar panel"} <= set(got[0])


def test_chunks_of_all_documents_are_slices(spark, data):
    docs = table(spark, data, "documents")
    for strategy, size, overlap in (("auto", 100, 20), ("fixed", 60, 0), ("recursive", 30, 10)):
        c = chunking.chunk(docs, strategy, size, overlap)
        bad = c.join(docs.select("doc_id", F.col("text").alias("whole")), "doc_id").where("text <> substring(whole, start_char + 1, end_char - start_char)")
        assert bad.count() == 0 and c.select("doc_id").distinct().count() == docs.count()
    wide = chunking.chunk(docs.repartition(8), "recursive", 50, 5)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, chunking.chunk(docs.coalesce(1), "recursive", 50, 5).collect()))


def test_windows_and_pages(spark):
    docs = spark.createDataFrame([(1, "abcdefg"), (2, "")], "doc_id long, text string")
    got = [(r["doc_id"], r["offset"], r["page_text"], r["remaining_chars"], r["has_more"]) for r in structure.windows(docs, 3).orderBy("doc_id", "offset").collect()]
    assert got == [(1, 0, "abc", 4, True), (1, 3, "def", 1, True), (1, 6, "g", 0, False), (2, 0, "", 0, False)]
    assert {r["doc_id"]: r["error"] is None for r in structure.page(docs, 7, 3).collect()} == {1: False, 2: False}


def test_overlap_of_chunks_and_pages(spark):
    spans = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 10, 25)], "doc_id long, chunk_id int, start_char int, end_char int")
    pages = spark.createDataFrame([(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 20, 30)], "doc_id long, page_no int, start int, end int")
    assert {r["chunk_id"]: (r["page_start"], r["page_end"]) for r in structure.overlapping(spans, pages).collect()} == {0: (1, 1), 1: (2, 3)}


def test_running_lines_need_many_pages(spark):
    rows = [(1, p, f"Report page {p}") for p in range(5)] + [(1, p, f"body {chr(97 + p)}") for p in range(5)]
    lines = spark.createDataFrame(rows, "doc long, page int, line string")
    assert [(r["running_key"], r["n_pages"]) for r in structure.running_lines(lines, "doc", "page", "line").collect()] == [("report page #", 5)]
    assert structure.without_running_lines(lines, "doc", "page", "line").count() == 5


def test_column_profile_types(spark):
    rows = [("1", "1.5", "true", "2024-01-02", "x", ""), ("-2", ".5", "FALSE", "2024-01-03", "1", None)]
    got = {r["column"]: (r["type"], r["null_count"]) for r in structure.column_profile(spark.createDataFrame(rows, "i string, f string, b string, d string, t string, e string")).collect()}
    assert got == {"i": ("integer", 0), "f": ("float", 0), "b": ("boolean", 0), "d": ("datetime", 0), "t": ("text", 0), "e": ("text", 2)}


def test_column_profile_tests_distinct_values_after_the_shuffle(spark):
    d = spark.createDataFrame([("a", "2024-01-02", "")] * 3 + [("b", "+999999-01-02", "")], "t string, d string, e string")
    got = structure.column_profile(d)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert "gettimestamp" not in plan[plan.index("keys=[column#", plan.index("gettimestamp")) :].split("\n", 1)[1]
    assert sorted(map(tuple, got.collect())) == [("d", "text", 0, 2), ("e", "text", 4, 0), ("t", "text", 0, 2)]


def test_dates_are_what_the_parser_accepts(spark):
    values = "2024-02-29 2023-02-29 2024-1-2 -0044-03-15 +12024-01-02 12024-01-02 2024-13-01 2024/01/02 01/02/2024 13/02/2024 02.01.2024 2024-01-02T10:11:12 2024-01-02t10:11:12 2024-01-02T24:00:00 now 20240102 x".split()
    values += ["2024-01-02 10:11:12", "2024-01-02 10:11", "2024-01-02 10:11:12\n", "02 Jan 2024", "02 sep 2024", "02 Sept 2024", "Jan 02, 2024", "\u017fep 02, 2024", "31 Feb 2024", ""]
    v = spark.createDataFrame([(x,) for x in values], "v string")
    plain = F.coalesce(*[F.try_to_timestamp("v", F.lit(f)) for f in structure.DATE_FORMATS]).isNotNull()
    assert v.where(plain != structure.is_date(F.col("v"))).collect() == [] and v.where(plain).count() >= 10


def test_breakpoints_reject_unknown_methods(spark):
    d = spark.createDataFrame([(1, 1, 0.5)], "g int, o int, distance double")
    with pytest.raises(ValueError):
        structure.breakpoints(d, "g", "o", "median")


def test_row_and_slide_chunks(spark):
    rows = spark.createDataFrame([("t", i, f"r{i}") for i in range(5)], "k string, n int, line string")
    got = chunking.row_chunks(rows, "k", "n", "line", 2, F.lit("head")).orderBy("chunk_id").collect()
    assert [(r["first_row"], r["last_row"], r["text"]) for r in got] == [(1, 2, "head\nr0\nr1"), (3, 4, "head\nr2\nr3"), (5, 5, "head\nr4")]
    items = spark.createDataFrame([("d", 1, 0, "T", "a"), ("d", 1, 1, "T", "b"), ("d", 2, 0, None, "c")], "doc_id string, slide_number int, ordinal int, title string, text string")
    assert [r["text"] for r in chunking.slide_chunks(items).orderBy("slide_number").collect()] == ["## Slide 1: T\n\na\nb", "## Slide 2\n\nc"]


def test_semantic_chunks(spark):
    paras = spark.createDataFrame([(1, i, f"{c} " * 60) for i, c in enumerate("abcd")], "doc_id long, para_no int, para string")
    cuts = spark.createDataFrame([(1, 2)], "doc_id long, para_no int")
    got = chunking.semantic_chunks(paras, cuts, 500, 0).orderBy("chunk_id").collect()
    assert [len(r["text"].split()) for r in got] == [120, 120]


def test_library_functions(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Alpha\n\nSome longer words of a document. " * 3)
    (tmp_path / "b.zzz").write_text("x")
    docs = api.parse(spark, str(tmp_path), max_chars=20)
    rows = {r["path"].rpartition("/")[2]: r for r in docs.collect()}
    assert rows["a.md"]["char_count"] == 20 and rows["b.zzz"]["error"].startswith("Unsupported")
    assert api.chunk(api.parse(spark, str(tmp_path)), chunk_size=10, overlap=0, keywords=True).count() >= 2
    assert api.extract_metadata(docs).where("format = 'markdown'").count() == 1
    got = api.batch(spark, [str(tmp_path / n) for n in ("b.zzz", "a.md", "none.md")]).collect()
    assert [r["success"] for r in got] == [False, True, False]
    assert api.get_format("x.YAML") == "yaml" and api.get_format("x.pdf") is None
    assert api.render_prompt(docs, "answer_question", question="why?").where("prompt like '%why?%'").count() == 1
    with pytest.raises(ValueError):
        api.parse(spark, str(tmp_path), ocr="maybe")


def test_pipeline_outputs(spark, data):
    docs = table(spark, data, "documents").limit(5)
    for output in api.Pipeline.RENDERERS:
        assert api.Pipeline("recursive", 80, 0, output).transform(docs).count() >= 5
    with pytest.raises(ValueError):
        api.Pipeline(output="papyrus")


def test_watching_sees_new_and_changed_files(spark, tmp_path):
    folder, state = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()
    (folder / "old.txt").write_text("old")
    watch.seed(spark, str(folder), state)
    seen = []
    sink = lambda df: seen.append(sorted((r["path"].rpartition("/")[2], r["text"]) for r in df.collect()))
    assert watch.poll(spark, str(folder), state, sink) == 0
    (folder / "new.md").write_text("# n")
    (folder / "skip.bin").write_text("x")
    assert watch.poll(spark, str(folder), state, sink, "*.md, .txt") == 1 and seen == [[("new.md", "# n")]]
    import os
    import time

    (folder / "old.txt").write_text("changed")
    later = time.time() + 5
    os.utime(folder / "old.txt", (later, later))
    assert watch.poll(spark, str(folder), state, sink, ".txt") == 1 and seen[-1] == [("old.txt", "changed")]
    assert watch.poll(spark, str(folder), state, sink, ".txt,.md") == 0


def test_stream_of_new_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    q = watch.stream_new_files(spark, str(tmp_path), "*.txt").writeStream.format("memory").queryName("seen_files").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r["text"] for r in spark.table("seen_files").collect()] == ["one"]
