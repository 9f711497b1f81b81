"""HTML text: the tokenizer's and tree builder's corner cases, spans, and the layout against a naive renderer."""

import random
import time

import pytest

from quire.llm import html_text
from quire.llm.html_text import Grid, extract
from quire.llm.html_tree import Node, parse, walk


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>a</p><!-->visible<p>more</p>", "a\n\nvisible\n\nmore"),
        ("a<!--->b<!-- x --!>c<!-- y -->d<!--open", "abcd"),
        ("<div>" * 400 + "<div hidden>secret</div>seen", "seen"),
        ("<a href=it's>link</a> <a href=x title='a>b'>two</a>", "link two"),
        ("<svg><g><text>in svg</text></g><title>no</title><style>no</style></svg><math><mi>x</mi><mo>=</mo><annotation>no</annotation></math>", "in svgx="),
        ("<svg><circle r=1/><path/>t<p>out</p>", "t\n\nout"),
        ("<svg><foreignObject><p>in</p></foreignObject><desc>no</desc></svg>after", "in\n\nafter"),
        ("<svg><![CDATA[a<b>c]]></svg><![CDATA[no]]>", "a<b>c"),
        ("<canvas>no</canvas><object data=x>no</object><object>yes</object>", "yes"),
        ("<b><p>one</b> two</p>three", "one two\n\nthree"),
        ("<div>a</span>b</p>c</div>", "ab\n\nc"),
        ("<head>shown<title>no</title></head>more", "shownmore"),
        ("<script><!--<script></script>no--></script>yes<script>no</scripty></script>!", "yes!"),
        ("<style>no</style >a<textarea>\n b\n  c</textarea><noscript><p>no</noscript>", "a b\n  c"),
        ("a<plaintext><b>x</b>", "a\n\n<b>x</b>"),
        ("x <b", "x"),
        ("1 < 2 <3 </ > </", "1 < 2 <3 </"),
        ("<ul><li>a<p>b<li>c<div><li>d</ul>", "• a\n\n  b\n• c\n• d"),
        ("<ol start=9 reversed><li>a<li value=3>b</ol><ol type=I start=4000><li>z</ol>", "9. a\n3. b\n\n4000. z"),
        ("<div style='display:none;display:block'>a</div><div style='/*display:none*/color:red'>b</div><p style='display:none !important;display:block'>no", "a\nb"),
        ("<span style='display:block'>a</span><div style='display:inline'>b</div><div style='display:inline'>c</div>", "a\nbc"),
        ("<details>no<summary>s</summary>no</details><details open>a<summary>s</summary></details><dialog>no</dialog>", "s\na\ns"),
        ("<table><tfoot><tr><td>f<tbody><tr><td>b<thead><tr><td>h</table>", "h\nb\nf"),
        ("<table>x<tr>y<td>1</td>z<td>2</table>", "xyz\n\n1  2"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>a longer one<td>z<tr><td>p<td>q<td>r</table>", "a  b\na longer one  z\np  q          r"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"),
        ("<p>x<table><tr><td>1<table><tr><td>2<td>3</table><td>4</table>y", "x\n\n1     4\n2  3\n\ny"),
        ("<select><option>a<option selected>b</select>", "a\nb"),
        ("a\r\nb\rc\0d", "a b cd"),
    ],
)
def test_corner_cases(source, want):
    assert extract(source) == want


@pytest.mark.parametrize(
    "source",
    ["<a " * 400_000, '<a "' * 400_000, "<!--" * 400_000, "<" * 1_500_000, "<script>" * 100_000, "</b>" * 200_000, "<td>" * 200_000, "<table><tr><td rowspan=60000>x" + "<td>y" * 40_000 + "<tr><td>z" * 40_000, "<div>x" * 60_000, "<table><td>x" * 30_000, "<ul><li>x" * 30_000, "<b><p>" * 30_000 + "</b>" * 30_000, "<table><td>" + "w" * 50_000 + "<td>x" + "<tr><td>y<td>z" * 20_000],
)
def test_broken_or_deep_pages_take_seconds(source):
    began = time.perf_counter()
    text = extract(source)
    assert time.perf_counter() - began < 15
    assert len(text) < 40 * len(source)


def test_grid_equals_a_table_of_cells():
    rng = random.Random(1)
    for _ in range(300):
        grid, taken = Grid(), {}
        for r in range(8):
            grid.row(r)
            c = 0
            for _ in range(rng.randrange(5)):
                c = grid.free(c)
                want = c
                while taken.get((r, want), False):
                    want += 1
                assert c == want and not taken.get((r, c))
                span, down = rng.choice([1, 1, 2, 5, 1000]), rng.choice([1, 1, 2, 3, 60000])
                if down != 1:
                    grid.hold(c, c + span, r + down - 1)
                    for k in range(c, c + span):
                        free = not taken.get((r, k))
                        for rr in range(r, min(8, r + down)) if free else ():
                            taken[rr, k] = True
                c += span


def random_tree(rng, depth=0):
    kinds = ["t", "t", "br"] + (["span", "b", "hide", "vis", "p", "div", "ul", "table", "blockquote", "pre"] if depth < 4 else [])
    out = []
    for _ in range(rng.randrange(1, 5)):
        k = rng.choice(kinds)
        if k == "t":
            out.append(" ".join(rng.choice(["aa", "b", "ccc"]) for _ in range(rng.randrange(1, 4))))
        elif k == "br":
            out.append(("br", []))
        elif k == "ul":
            out.append((k, [("li", inline(rng)) for _ in range(rng.randrange(1, 4))]))
        elif k == "table":
            out.append((k, [("tr", [("td", inline(rng)) for _ in range(3)]) for _ in range(rng.randrange(1, 4))]))
        elif k in ("p", "pre"):
            out.append((k, inline(rng)))
        else:
            out.append((k, random_tree(rng, depth + 1)))
    return out


def inline(rng):
    return [rng.choice(["x", "yy z", "w  w"]) if rng.random() < 0.7 else (rng.choice(["b", "span", "hide"]), ["q"]) for _ in range(rng.randrange(1, 4))]


def source_of(tree):
    out = ""
    for node in tree:
        if isinstance(node, str):
            out += node
            continue
        tag, children = node
        opened = {"hide": "<span hidden>", "vis": "<span style='visibility:hidden'>"}.get(tag, f"<{tag}>")
        out += opened + ("" if tag == "br" else source_of(children) + ("</span>" if tag in ("hide", "vis") else f"</{tag}>"))
    return out


def words_of(tree, seen=True):
    out = []
    for node in tree:
        if isinstance(node, str):
            out += list(node.replace(" ", "")) if seen else []
        elif node[0] != "hide":
            out += words_of(node[1], seen and node[0] != "vis")
    return out


def naive(tree, width=0, seen=True):
    """Blocks as (gap, lines) by recursion: a run of inline content is one block."""
    blocks, run, pending = [], "", False

    def put(text, keep=False):
        nonlocal run, pending
        if keep:
            run += (" " if pending and run and not run.endswith("\n") else "") + text
            pending = False
            return
        for i, part in enumerate(text.split(" ")):
            pending = pending or i > 0
            if part:
                run += (" " if pending and run and not run.endswith("\n") else "") + part
                pending = False

    def end():
        nonlocal run, pending
        if run.strip():
            blocks.append((0, run.strip("\n").split("\n")))
        run, pending = "", False

    def go(nodes, seen, keep=False):
        nonlocal run, pending
        for node in nodes:
            if isinstance(node, str):
                if seen:
                    put(node, keep)
                continue
            tag, children = node
            if tag == "hide":
                continue
            if tag == "br":
                run, pending = run + "\n", False
            elif tag in ("span", "b", "vis"):
                go(children, seen and tag != "vis", keep)
            else:
                gap = 0 if tag == "div" else 1
                end()
                blocks.append((gap, []))
                if tag in ("p", "div", "pre"):
                    go(children, seen, keep or tag == "pre")
                elif tag == "blockquote":
                    at = len(blocks)
                    go(children, seen, keep)
                    end()
                    blocks[at:] = [(g, ["    " + x if x else x for x in lines]) for g, lines in blocks[at:]]
                elif tag == "ul":
                    for _, inner in children:
                        for _, lines in naive_blocks(inner, seen, keep):
                            blocks.append((0, [("• " if i == 0 else "  ") + x if x else x for i, x in enumerate(lines)]))
                elif tag == "table":
                    cells = [[[x for _, lines in naive_blocks(c, seen, keep) for x in lines] for _, c in row] for _, row in children]
                    wide = [max(max(map(len, r[k]), default=0) for r in cells) for k in range(3)]
                    for r in cells:
                        for k in range(max(map(len, r))):
                            line = "".join((c[k] if k < len(c) else "").ljust(w + 2 if w else 0) for c, w in zip(r, wide, strict=True)).rstrip()
                            if line:
                                blocks.append((0, [line]))
                end()
                blocks.append((gap, []))

    def naive_blocks(inner, seen, keep):
        nonlocal blocks, run, pending
        held = blocks, run, pending
        blocks, run, pending = [], "", False
        go(inner, seen, keep)
        end()
        out = [b for b in blocks if b[1]]
        blocks, run, pending = held
        return out

    go(tree, seen)
    end()
    out, gap = [], 0
    for g, lines in blocks:
        gap = max(gap, g)
        if lines:
            out += ([""] if gap and out else []) + [x.rstrip() for x in lines]
            gap = 0
    return "\n".join(out)


def test_layout_equals_a_naive_renderer():
    rng = random.Random(7)
    tried = 0
    for _ in range(3000):
        tree = random_tree(rng)
        source = source_of(tree)
        assert [c for c in extract(source).replace("•", "") if not c.isspace()] == words_of(tree), source
        if "<ul" in source and "<blockquote" in source:
            continue  # a list in an indented block opens without a margin; the naive renderer doesn't say so
        assert extract(source) == naive(tree), source
        tried += 1
    assert tried > 1000


def test_tree_holds_all_text_and_walk_is_in_order():
    tree = parse("<div>a<p>b<i>c</i></div>d")
    assert [n if isinstance(n, str) else n.tag for n in walk(tree)] == ["div", "a", "p", "b", "i", "c", "d"]
    assert isinstance(tree, Node) and html_text.draw(tree) == ["a", "", "bc", "", "d"]
