"""Mixing, WARC, BPE, HTML text and the pipeline."""

import gzip
import hashlib
import random

import public_tokenizers as tok
import pyarrow.fs as fs
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from quire.llm import bpe, html_text, mixing, warc
from quire.llm.common import staged, staged_path
from quire.session import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PATH = tok.path("byte_bpe_50k.tiktoken")
CODEC = bpe.codec(PATH, tok.PATTERN)
REAL = tiktoken.Encoding("own", pat_str=tok.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def targets_brute(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, open_, out = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if total * weight[s] / w > 2 * sizes[s]]
        if not over:
            return out | {s: total * weight[s] / w for s in open_}
        for s in over:
            out[s] = 2.0 * sizes[s]
        total -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


def mixed_docs(spark, seed=1):
    rng = random.Random(seed)
    rows = []
    for s, n in (("a", 400), ("b", 60), ("é", 30), (None, 50), ("Z", 8), ("empty", 3)):
        for _ in range(n):
            size = 0 if s == "empty" else rng.choice([0, 1, 3, 10, 40, 40, 40, 200, 700])
            rows.append((len(rows), "w " * size if rng.random() > 0.05 or size else None, "en", s, size))
    return spark.createDataFrame(rows, DOCS)


def test_mixing_meets_targets(spark):
    docs = mixed_docs(spark)
    rows = mixing.mix_sources(docs).collect()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = targets_brute(sizes)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(2, 0.01 * t), (s, taken[s], t)
    again = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}


def test_mixing_copies_rows(spark):
    docs = mixed_docs(spark, 2).selectExpr("*", "doc_id AS n_points", "'z' AS copies", "1 AS key")
    twice = docs.union(docs.where("doc_id < 5"))
    out = mixing.mix_documents(twice)
    assert out.columns == docs.columns
    plan = mixing.mix_sources(twice).collect()
    assert out.count() == sum(r["copies"] for r in plan)
    assert all(r["n_points"] == r["doc_id"] for r in out.collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "a b", "en", "s", 3)], DOCS)
    assert mixing.mix_sources(null_id).collect()[0]["taken"] in (2, 4)


def test_mixing_sizes_and_targets_equal_sql(spark, data):
    import duckdb

    sql = f"""
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{data}/documents.parquet'),
        s AS (SELECT source, sum(size) AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source),
        fill(k, taken, open_weight, level) AS (
            SELECT 0, 0.0, sum(weight)::DOUBLE, 1.5 * sum(source_size) / sum(weight) FROM s
            UNION ALL
            SELECT k + 1, n.taken, n.open_weight, (n.total - n.taken) / n.open_weight FROM fill, LATERAL (
                SELECT coalesce(sum(2.0 * source_size) FILTER (2 * source_size <= weight * level), 0)::DOUBLE AS taken,
                coalesce(sum(weight) FILTER (2 * source_size > weight * level), 0)::DOUBLE AS open_weight, (1.5 * sum(source_size))::DOUBLE AS total FROM s) n
            WHERE k < 20 AND n.open_weight > 0)
        SELECT doc_id, size, source_size, CASE WHEN 2 * source_size <= weight * level THEN 2 * source_size ELSE weight * level END
        FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, (SELECT level FROM fill ORDER BY k DESC LIMIT 1)
    """
    want = {r[0]: r[1:] for r in duckdb.sql(sql).fetchall()}
    got = {r["doc_id"]: (r["size"], r["source_size"], r["target"]) for r in mixing.mix_sources(table(spark, data, "documents")).collect()}
    assert got.keys() == want.keys()
    for i, (size, whole, target) in want.items():
        assert got[i][:2] == (size, whole) and abs(got[i][2] - target) < 1e-6 * max(1, target)


def test_mixing_tells_rows_of_one_id_apart_by_size(spark):
    rows = [(1, "aaa b " * 30, "en", "s", 0), (1, "a  a  " * 30, "en", "s", 0), (1, "aaaaaa" * 30, "en", "s", 0)] + [(i, "w " * (i % 7), "en", "s", 0) for i in range(2, 40)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sum(r["taken"] for r in mixing.mix_sources(docs).collect())
    assert sum(len(r["text"].split()) for r in mixing.mix_documents(docs).collect()) == want


def test_mixing_plan_is_native(spark):
    docs = mixed_docs(spark)
    plan = mixing.mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def page_rows(n=60):
    rng = random.Random(3)
    bodies = ["<p>same</p>", "", "<b>x</b>", "é" * 50]
    rows = [(i, rng.choice([f"http://www.Example{i % 5}.com:80/P/{i}?q=1", "https://a.b.org/x", None, "not a url"]), rng.choice([*bodies, f"<p>{i}</p>", None])) for i in range(n)]
    return [*rows, (7, rows[7][1], rows[7][2]), (None, "http://n/", "<p>same</p>")]


def warc_brute(rows):
    import base64

    least = {}
    for i, _, h in rows:
        k = (i is not None, i or 0)
        least[h or ""] = min(least.get(h or "", k), k)
    out = []
    for i, _, h in rows:
        first = least[h or ""]
        again = (i is not None, i or 0) != first
        data = (h or "").encode()
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", (first[1] if first[0] else None) if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark):
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS file", "2 AS length")
    got = sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str)
    assert got == warc_brute(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_files_and_index(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}.com/{i // 2}", f"<p>{i}</p>") for i in range(1500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = staged_path(spark, "warc-test")
    lines = warc.write_archives(pages, folder)
    top = warc.write_index(lines, folder, 3)
    files, base = warc.open_folder(folder)
    names = [i.base_name for i in files.get_file_info(fs.FileSelector(base))]
    archives = [n for n in names if n.endswith(".warc.gz")]
    text = b"".join(gzip.decompress(files.open_input_stream(f"{base}/{n}", compression=None).read()) for n in archives)
    assert text.count(b"WARC/1.1\r\n") == 1500 and 1 < len(top) <= 3
    index = warc.CaptureIndex(folder, top)
    for i in (0, 1, 2, 511, 512, 777, 1499):
        found = index.captures(rows[i][1], i)
        assert [c["payload"] for c in found] == [rows[i][2].encode()]
    assert index.captures("http://nowhere/", 3) == [] and index.captures(rows[0][1], 999) == []
    same = [r for r in rows if r[1] == rows[600][1]]
    assert [c["payload"] for c in index.of_url(rows[600][1])] == [r[2].encode() for r in same]
    assert sorted(c["payload"] for c in index.of_host("h1.com")) == sorted(r[2].encode() for r in rows if "h1.com" in r[1])
    assert len(list(index.of_domain("com"))) == 1500 and not list(index.of_domain("om")) and not list(index.of_host("h9.com"))


def test_warc_files_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(warc, "PART", 7)
    rows = page_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str) == warc_brute(rows)
    monkeypatch.setattr(warc, "PART", 10**9)
    assert sorted((tuple(r) for r in warc.round_trip(pages).collect()), key=str) == warc_brute(rows)


def test_url_keys_sort_by_domain():
    assert warc.url_key("https://www.Example.com:8080/A/b?x=1") == "com,example:8080)/a/b?x=1"
    assert warc.url_key("http://a.b.example.com") == "com,example,b,a)/"
    assert warc.url_key(None) == ")"
    assert warc.sort_key("k", -5) < warc.sort_key("k", 3) < warc.sort_key("k", 20)


def test_bpe_equals_the_library(spark, data):
    docs = table(spark, data, "documents")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "a" * 5000), (10**6 + 3, "中文 😀‍\n\n  x"), (10**6 + 4, "<|endoftext|> 's'll")]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 AS n_tokens", "2 AS ids")
    texts = {r["doc_id"]: r["text"] or "" for r in both.collect()}
    for r in bpe.bpe_round_trip(both, PATH, tok.PATTERN, with_ids=True).collect():
        want = REAL.encode_ordinary(texts[r["doc_id"]])
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert bpe.bpe_round_trip(both.limit(0), PATH, tok.PATTERN).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_on_any_text(text):
    ids = CODEC.encode(text)
    assert ids == REAL.encode_ordinary(text)
    assert CODEC.decode(ids).decode() == text and "".join(CODEC.stream(ids, 2)) == text


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=40))
def test_transducer_equals_the_merges(piece):
    if piece and piece not in CODEC.transducer.ranks:
        assert CODEC.transducer.encode(piece) == CODEC.transducer.merge(piece)


def test_transducer_emits_long_pieces_in_runs():
    rng = random.Random(8)
    piece = "".join(rng.choice("aethino") for _ in range(6000)).encode()
    assert list(CODEC.transducer.emit(piece)) == REAL.encode_ordinary(piece.decode())


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.binary(max_size=30), st.text(max_size=20).map(str.encode), st.lists(st.sampled_from(b"\xe2\x82\xac\xf0\x9f\x98\x80\xed\xa0\xc3\xa9a\xf4\x90\xc0\xff"), max_size=20).map(bytes)), st.lists(st.integers(1, 5), max_size=30))
def test_utf8_stream_equals_whole_decoding(data, cuts):
    stream, at, out = bpe.Utf8Stream(), 0, ""
    for n in [*cuts, len(data) + 1]:
        out += stream.feed(data[at : at + n])
        at += n
    assert out + stream.close() == data.decode("utf-8", "replace")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50_000), max_size=40), st.integers(1, 7))
def test_stream_of_any_tokens_equals_whole_decoding(ids, run):
    ids = [i for i in ids if i in CODEC.transducer.bytes_of]
    assert "".join(CODEC.stream(ids, run)) == CODEC.decode(ids).decode("utf-8", "replace")


HTML = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><script>var x="</p>";</script>
<h1>One &amp; <i>two</i></h1><p>first<p>second <b>bold<br>line</b><div hidden>no</div><span style="DISPLAY : none">no</span>
<ul><li>a<li>b<ol start=3 type=a><li>c<li>d</ol></ul><table><tr><th>Name<th>N<tr><td>apple<td>1<tr><td>fig<td>22</table>
<pre> x
   y</pre><!-- no --><noscript>no</noscript><div style="visibility:hidden">no<span style="visibility:visible">yes</span></div></body></html>"""


def test_html_layout():
    want = "One & two\n\nfirst\n\nsecond bold\nline\n\n• a\n• b\n  c. c\n  d. d\n\nName   N\napple  1\nfig    22\n\n x\n   y\n\nyes"
    assert html_text.extract(HTML) == want


def test_html_edges(spark):
    rows = [(1, None), (2, ""), (3, HTML), (3, HTML), (4, "<b>" * 3000 + "deep"), (5, "a < b & c > d </nope> <p"), (6, "<table><td>x<table><td>y</table></table>")]
    out = html_text.html_text(spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    texts = [r["text"] for r in sorted(out, key=lambda r: r["page_id"])]
    assert texts[:2] == ["", ""] and texts[2] == texts[3] and texts[4] == "deep" and texts[5].startswith("a < b & c > d") and texts[6].split() == ["x", "y"]
    assert all(r["n_chars"] == len(r["text"]) for r in out)


def test_html_tables_with_implied_rows_and_loose_content():
    grid = "Name  Age\nx     y"
    for source in (
        "<table><thead><th>Name<th>Age<tbody><tr><td>x<td>y</table>",
        "<table><tbody><th>Name</th><th>Age</th></tbody><td>x<td>y</table>",
        "<table><form><tr><td>Name</td><td>Age</td></tr><tr><td>x<td>y</form></table>",
        "<table><tbody><form style='display:none'><tr><td>Name<td>Age<tr><form><td>x<td>y</table>",
        "<table><div><td>Name<td>Age</div><tr><td>x<td>y</table>",
    ):
        assert html_text.extract(source) == grid, source
    assert html_text.extract("<table><td>x<td>y</table>") == "x  y"
    assert html_text.extract("<table><caption>c<td>x<td>y</table>") == "c\nx  y"
    for part in ("thead", "tbody", "tfoot"):
        got = html_text.extract(f"<table><tr><td>a</td></tr><{part}>t<div>d</div><b>e</b><tr><td>x<td>y</tr>u</{part}></table>z")
        assert sorted(got.split()) == sorted("a d eu t x y z".split()), got
    assert html_text.extract("<table><colgroup>t<col></colgroup><tr><td>x</table>").split() == ["t", "x"]
    assert html_text.extract("<table><tbody hidden><td>x<td>y</tbody><tbody><td>z</table>") == "z"
    for depth in range(145, 153):
        assert sorted(html_text.extract("<div>" * depth + "<table><td>x <td>y <form>f</table>").split()) == ["f", "x", "y"]
    assert html_text.extract("<table><tr><td>a<table><td>b<td>c</table>d<td>e</table>").split() == ["a", "e", "b", "c", "d"]


def test_html_raw_text_ends_where_its_end_tag_stands():
    for tag in ("script", "STYLE", "title", "textarea"):
        inner = "" if tag == "textarea" else "var a=1;"
        source = "\u0130" * 12 + f"<{tag}>{inner}</{tag.swapcase()}> visible words here <b>more</b>"
        assert html_text.extract(source) == "\u0130" * 12 + " visible words here more", tag
    assert html_text.extract("a<script>x</\u017fcript>y</script >b<style>open") == "ab"


def test_html_of_pages_keeps_all_visible_text(spark, data):
    import re

    pages = {r["page_id"]: r["html"] for r in table(spark, data, "pages").collect()}
    for r in html_text.html_text(table(spark, data, "pages")).collect():
        body = re.sub(r"<script>.*?</script>|<style>.*?</style>|<title>.*?</title>|<!--.*?-->", "", pages[r["page_id"]], flags=re.S)
        import html as H

        want = H.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = r["text"].replace("• ", " ").split()
        assert got == want


def test_pipeline_stages_against_brute_force(spark, data):
    from tests.llm.test_dedup import exact_brute, near_brute
    from tests.llm.test_filters import brute_counts

    docs = table(spark, data, "documents")
    columns = docs.columns
    (_, rules), (_, exact), (_, near), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    kept = staged(rules(spark, docs, data), "t1")
    assert kept.columns == columns
    ids = {r["doc_id"] for r in kept.collect()}
    for r in docs.collect():
        c = brute_counts(r["text"])
        if c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]:
            assert r["doc_id"] not in ids
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    single = staged(exact(spark, kept, data), "t2")
    assert single.columns == columns
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(i for i, _, _, k, _ in exact_brute(rows) if k)
    rows = [(r["doc_id"], r["text"]) for r in single.collect()]
    apart = staged(near(spark, single, data), "t3")
    assert apart.columns == columns
    assert sorted(r["doc_id"] for r in apart.collect()) == sorted(i for i, _, _, k in near_brute(rows) if k)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_sources(apart).collect()}
    mixed = staged(mix(spark, apart, data), "t4")
    assert mixed.columns == columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert times == {i: n for i, n in plan.items() if n}
    out = tokens(spark, mixed, data).collect()
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert len(out) == sum(times.values())
    assert all(r["n_tokens"] == len(REAL.encode_ordinary(texts[r["doc_id"]])) for r in out)
    whole = corpus_pipeline.run(spark, data).collect()
    assert sorted(map(tuple, whole)) == sorted(map(tuple, out))


def test_pipeline_on_odd_rows(spark, data):
    rows = [(None, "a " * 20, None, None, None), (1, None, "en", None, 0), (2, "", "en", "s", 0), (3, " ".join(map(str, range(50))), None, "s", None), (3, " ".join(map(str, range(50))), None, "s", None)]
    docs = spark.createDataFrame(rows, DOCS)
    for some in (docs, docs.limit(0)):
        at = some
        for _, stage in corpus_pipeline.STAGES:
            at = staged(stage(spark, at, data), "odd")
        assert at.count() <= 2
