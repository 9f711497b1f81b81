"""Chunks by format, images and the command line."""

import json
import struct

import pytest

from quire import cli
from quire.operators import format_chunks, images
from quire.operators import page_lines as pl
from quire.sources.read import parse_files


def parsed(spark, *files):
    return parse_files(spark.createDataFrame([(n, b if isinstance(b, bytes) else b.encode()) for n, b in files], "path string, content binary"))


def chunks(spark, name, body, **options):
    return [r.asDict() | {"details": json.loads(r["details"])} for r in format_chunks.chunk_files(parsed(spark, (name, body)), **options).orderBy("chunk_id").collect()]


def test_code_chunks(spark):
    code = "import os\nimport sys\n\n\ndef f(a):\n    return a\n\n\nclass K:\n" + "".join(f"    x{i} = {i}\n" for i in range(40))
    got = chunks(spark, "a.py", code, chunk_size=200, overlap=500)
    assert [(c["section_type"], c["section_name"]) for c in got[:2]] == [("imports", None), ("function", "f")]
    assert all(c["section_type"] == "class" and c["chunk_strategy"] == "class_split" and len(c["text"]) <= 200 for c in got[2:]) and len(got) > 4


def test_csv_chunks_repeat_the_header(spark):
    body = "a,b\n" + "".join(f"{i},{i}\n" for i in range(150))
    got = chunks(spark, "t.csv", body)
    assert len(got) == 2 and all(c["text"].startswith("| a | b |\n") for c in got)
    assert chunks(spark, "s.csv", "a,b\n1,2\n")[0]["chunk_strategy"] == "csv"


def test_page_chunks(spark):
    words = "word " * 60
    semantic = f"<body><article><h2>A</h2><p>{words}</article><section><p>{words}</section><section><p>x y</section><table><tr><th>h<th>k<tr><td>1<td>2</table></body>"
    got = chunks(spark, "p.html", semantic)
    assert {c["chunk_strategy"] for c in got} == {"semantic", "table"} and got[-1]["text"].startswith("<table>")
    heads = "<body>" + "".join(f"<h2>H{i}</h2><p>text {i}</p>" for i in range(6)) + "</body>"
    assert [c["section_name"] for c in chunks(spark, "q.html", heads)] == [f"H{i}" for i in range(6)]
    assert chunks(spark, "r.html", "<p>short one")[0]["chunk_strategy"] == "fixed_size"


def test_workbook_plans():
    sheet = {"sheet_name": "S", "sheet_index": 0, "text": "| a | b |\n| --- | --- |\n| 1 | x\\|y |", "tables": [], "max_row": 2, "max_column": 2}
    table = {"start_row": 1, "start_col": 1, "end_row": 2, "end_col": 2, "header_row": 1}
    plans = lambda s, **m: {p["chunk_strategy"] for p in format_chunks.workbook_pieces({"sheets": s}, m)}
    assert plans([sheet, sheet], has_multiple_sheets=True) == {"by_sheet"}
    assert plans([sheet | {"tables": [table]}]) == {"by_table"}
    many = "\n".join(["| a |", "| --- |", *(f"| {i} |" for i in range(130))])
    long = sheet | {"text": many, "max_row": 131, "tables": [table | {"end_row": 131, "end_col": 1}]}
    got = format_chunks.workbook_pieces({"sheets": [long]}, {})
    assert [p["chunk_strategy"] for p in got] == ["by_rows"] * 2 and all(p["text"].startswith("a\n") for p in got)
    assert "<td>x|y</td>" in format_chunks.workbook_pieces({"sheets": [sheet]}, {"has_multiple_sheets": True})[0]["text"]


def test_errors_have_no_chunks(spark):
    assert format_chunks.chunk_files(parsed(spark, ("x.json", "{"), ("y.zzz", ""))).count() == 0
    with pytest.raises(ValueError):
        format_chunks.chunk_files(parsed(spark, ("x.txt", "a")), chunk_size=0)


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 320, 200)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 30) + b"\0" * 10


def test_probe():
    assert images.probe(PNG) == (320, 200)
    assert images.probe(JPEG) == (30, 20)
    assert images.probe(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert images.probe(b"") is None and images.probe(b"RIFFxxxx") is None


def test_image_rows(spark):
    rows = [(1, "i1", 1, 0, PNG), (1, "i2", 2, 1, JPEG), (1, "i3", 2, 2, PNG), (1, "i4", None, 3, b"zz")]
    table = spark.createDataFrame(rows, "doc_id long, image_id string, page int, ordinal int, content binary")
    sized = {r["image_id"]: (r["width"], r["height"]) for r in images.with_size(table).collect()}
    assert sized == {"i1": (320, 200), "i2": (30, 20), "i3": (320, 200), "i4": (None, None)}
    got = {r["image_id"]: (r["pages"], r["aliases"]) for r in images.distinct_images(table).collect()}
    assert got == {"i1": ([1, 2], ["i3"]), "i2": ([2], []), "i4": ([], [])}
    assert [r["image_id"] for r in images.select(table, image_id="i3").collect()] == ["i1"]
    assert images.select(table, page=2).count() == 2 and images.select(table, most=1).count() == 1
    kinds = {r["image_id"]: r["m"] for r in table.select("image_id", images.mime_type().alias("m")).collect()}
    assert kinds["i1"] == "image/png" and kinds["i2"] == "image/jpeg"


LINES = "doc_id string, page int, ordinal int, text string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, y_frac double"


def book(spark):
    rows, n = [], 0
    for page in range(1, 6):
        body = [("Running title", 0.05, 9.0, False), (f"Chapter {page}", 0.2, 18.0, True), (f"{page}.1 Scope of it", 0.3, 13.0, True)] + [(f"Plain words of a long body line number {k} of page {page} here", 0.4 + k / 50, 11.0, False) for k in range(6)] + [("A bold line", 0.6, 11.0, True), ("Total = 12 + 30", 0.7, 11.0, False), ("Cash Dr 500", 0.72, 11.0, False), (f"Page {page} of 5", 0.95, 9.0, False)]
        for text, y, size, bold in body:
            rows.append(("b", page, n, text, 50.0, y * 800, 300.0, y * 800 + 10, size, bold, y))
            n += 1
    return spark.createDataFrame(rows, LINES)


def test_page_line_structure(spark):
    lines = book(spark)
    marked = pl.with_noise(lines)
    noise = {(r["text"].rstrip("12345 of"), r["noise"]) for r in marked.where("noise IS NOT NULL").collect()}
    assert ("Running title", "running") in noise and ("Page", "boilerplate") in noise and len(noise) == 2
    assert pl.body_sizes(lines).collect()[0]["body"] == 11.0
    kept = marked.where("noise IS NULL")
    found = pl.headings(kept)
    levels = {(r["text"].split()[0] if r["text"][0].isalpha() else "n.1", r["level"], r["signal"]) for r in found.collect()}
    assert ("Chapter", 1, "size") in levels and ("n.1", 2, "numbering") in levels and ("A", 3, "bold") in levels
    path = {r["text"]: r["heading_path"] for r in pl.with_heading_path(kept, found).where("page = 2 AND size = 11 AND NOT bold").collect()}
    assert any(p.startswith("Chapter 2 > 2.1 Scope of it") for p in path.values())
    runs = [(r["kind"], r["line_count"]) for r in pl.math_regions(kept).collect()]
    assert runs == [("t_account", 2)] * 5


@pytest.mark.parametrize(("text", "want"), [("This sentence just breaks off before", True), ("This one is complete.", False), ("# A heading without stop here", False), ("- item of a list that goes", False), ("as agreed with Smith and Co.", True), ("it counts 2019 2020 2021", False), ("", False), ("It introduces a list:", False)])
def test_mid_sentence(spark, text, want):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(pl.ends_mid_sentence().alias("x")).collect()[0]["x"] == want


def test_command_line(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# T\n\nsome words in a document body")
    out = tmp_path / "out"
    cli.main([str(tmp_path / "in"), "--mode", "chunk", "--output", "json", "--write", str(out)])
    assert spark.read.json(str(out)).count() == 1
    cli.main([str(tmp_path / "in"), "--mode", "metadata", "--format", "csv", "--write", str(tmp_path / "csv")])
    assert cli.arguments(["--mode", "formats"]).mode == "formats"
    with pytest.raises(SystemExit):
        cli.arguments(["--mode", "watch", "x"])
