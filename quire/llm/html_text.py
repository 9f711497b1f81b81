"""HTML extraction by layout: a tree builder with implied tags, visibility rules, and a text layout of what is left.

All visible text is emitted. Blocks are lines or, with a margin, paragraphs; list items carry their marker at their
depth; the cells of a table's rows are padded to common column widths; preformatted text keeps its spaces. Tree and
layout are walked with stacks of their own, not by recursion, so depth has no limit.

Three bounds shape the layout, never the text: an indent stops growing at INDENT columns, a cell wider than WIDEST
columns does not widen its column (what follows it in its row moves on), and tables nested in NESTED others are laid out
cell by cell instead of in columns. Without them, padding could make the output quadratic in the source.

Visible is what a browser with scripts shows before any of them runs, by tags, attributes and inline styles; style sheets
are not read. Defined results: null or empty html gives an empty text; broken markup never fails (see `html_tree`); rows
are independent, so ties and repeated rows need nothing, and a null page_id keeps its row; further columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import slices
from quire.llm.html_tree import SECTIONS, Node, parse

INDENT = 80
WIDEST = 120
NESTED = 6

#: Never shown, whatever their style.
UNSEEN = frozenset("head title script style template noscript iframe audio video canvas datalist noembed noframes meta link base param source track map rp".split())
UNSEEN_FOREIGN = frozenset("title desc metadata defs style script symbol clippath mask pattern marker lineargradient radialgradient filter annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr listing menu ol p plaintext pre table ul dir xmp".split())
KEEPS_SPACE = frozenset("pre listing plaintext xmp textarea".split())
SHOWN_INPUTS = frozenset("submit reset button text search email url tel number".split())
#: display values by what they make of an element.
AS_BLOCK = frozenset("block flex grid list-item flow-root table".split())
AS_INLINE = frozenset("inline inline-block inline-flex inline-grid contents".split())

SPACE = re.compile(r"[ \t\n\f\r]+")
STYLE_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
WHOLE = re.compile(r"[ \t\n\f\r]*([+-]?[0-9]{1,9})")


def columns(text: str) -> int:
    """The width of text in a fixed grid: wide characters count two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def roman(n: int) -> str:
    if not 0 < n < 4000:
        return str(n)
    out = ""
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        times, n = divmod(n, value)
        out += sign * times
    return out


def letters(n: int) -> str:
    if n < 1:
        return str(n)
    out = ""
    while n > 0:
        n, r = divmod(n - 1, 26)
        out = chr(97 + r) + out
    return out


LABELS = {"a": letters, "i": roman, "A": lambda n: letters(n).upper(), "I": lambda n: roman(n).upper()}


def whole(text: str | None, default: int) -> int:
    found = WHOLE.match(text or "")
    return int(found[1]) if found else default


def style_of(node: Node) -> dict[str, str]:
    """The inline style's last (or important) value of each property."""
    raw = node.attributes.get("style")
    if not raw:
        return {}
    out: dict[str, str] = {}
    firm = set()
    for part in STYLE_COMMENT.sub("", raw).lower().split(";"):
        name, colon, value = part.partition(":")
        name, value = name.strip(), value.strip()
        important = value.endswith("!important")
        if colon and value and (important or name not in firm):
            out[name] = value.removesuffix("!important").strip()
            if important:
                firm.add(name)
    return out


class Layout:
    """Lines of one flow: a page, or a table cell."""

    def __init__(self, depth: int = 0):
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.space = False
        self.margin = 0
        self.indent = ""
        self.marker = ""
        self.depth = depth

    def text(self, s: str) -> None:
        s = s.replace("\xa0", " ") if s.isspace() else s
        parts = SPACE.split(s)
        for i, p in enumerate(parts):
            self.space = self.space or i > 0
            if p:
                if self.space and self.inline and not self.inline[-1].endswith("\n"):
                    self.inline.append(" ")
                self.inline.append(p.replace("\xa0", " "))
                self.space = False

    def kept(self, s: str) -> None:
        if s:
            if self.space and self.inline and not self.inline[-1].endswith("\n"):
                self.inline.append(" ")
            self.space = False
            self.inline.append(s)

    def line_break(self) -> None:
        self.inline.append("\n")
        self.space = False

    def flush(self) -> None:
        text = "".join(self.inline)
        self.inline, self.space = [], False
        if text and not text.isspace():
            self.add(text.strip("\n").split("\n"))

    def add(self, lines: list[str]) -> None:
        if self.lines and self.margin:
            self.lines.append("")
        self.margin = 0
        for line in lines:
            front = self.indent
            if self.marker:
                front, self.marker = front[: max(0, len(front) - len(self.marker))] + self.marker, ""
            self.lines.append((front + line).rstrip())

    def open(self, margin: int) -> None:
        self.flush()
        if not self.marker:
            self.margin = max(self.margin, margin)

    def close(self, margin: int) -> None:
        self.flush()
        self.margin = max(self.margin, margin)

    def deeper(self, by: int) -> str:
        """Indents what follows; returns the indent to go back to."""
        held = self.indent
        self.indent += " " * min(by, max(0, INDENT - len(held)))
        return held


#: Content to draw: its steps (texts, nodes, further frames), the flow, visibility, kept spaces, closing margin (-1: inline).
Frame = tuple[Iterator, Layout, bool, bool, int]


def draw(root: Node) -> list[str]:
    """The lines of a tree."""
    page = Layout()
    stack: list[Frame] = [(iter(root.children), page, True, False, 0)]
    while stack:
        steps, out, visible, pre, margin = stack[-1]
        for step in steps:
            if isinstance(step, str):
                if visible:
                    out.kept(step) if pre else out.text(step)
                continue
            frame = step if isinstance(step, tuple) else enter(step, out, visible, pre)
            if frame is not None:
                stack.append(frame)
                break
        else:
            stack.pop()
            if margin >= 0:
                out.close(margin)
    return page.lines


def shown(node: Node, visible: bool) -> tuple[bool, bool, dict[str, str]]:
    """Whether node has a place in the layout, whether its own text shows, and its style."""
    tag, a = node.tag, node.attributes
    if tag in (UNSEEN_FOREIGN if node.foreign else UNSEEN):
        return False, False, {}
    if not a:
        return tag != "dialog", visible, {}
    style = style_of(node)
    gone = "hidden" in a and a["hidden"].lower() != "until-found" and "display" not in style and not node.foreign
    if gone or tag == "dialog" and "open" not in a and "display" not in style or tag == "object" and a.get("data"):
        return False, False, style
    if style.get("display") == "none" or style.get("content-visibility") == "hidden":
        return False, False, style
    seen = style.get("visibility")
    return True, visible if seen is None or seen == "inherit" else seen not in ("hidden", "collapse"), style


def enter(node: Node, out: Layout, visible: bool, pre: bool) -> Frame | None:
    """The frame that draws an element, or None when nothing is left to draw."""
    here, visible, style = shown(node, visible)
    if not here:
        return None
    tag, a = node.tag, node.attributes
    if node.foreign:
        return iter(node.children), out, visible, pre, -1
    if tag == "br":
        out.line_break()
        return None
    if tag == "input":
        if visible and a.get("value") and a.get("type", "text").lower() in SHOWN_INPUTS:
            out.text(f" {a['value']} ")
        return None
    if tag == "hr":
        out.open(1)
        out.close(1)
        return None
    if tag in KEEPS_SPACE:
        pre = True
    space = style.get("white-space")
    if space:
        pre = space.startswith("pre") or space == "break-spaces"
    display = style.get("display", "")
    if tag in ("ul", "ol", "menu", "dir"):
        return items(node, out, visible, pre), out, visible, pre, -1
    if tag == "table":
        return table(node, out, visible, pre), out, visible, pre, -1
    if tag == "details" and "open" not in a:
        return summary(node, out, visible), out, visible, pre, -1
    if tag in ("dd", "blockquote"):
        return indented(node, out, int(tag == "blockquote")), out, visible, pre, -1
    if display in AS_BLOCK or tag in BLOCK and display not in AS_INLINE:
        gap = int(tag in SPACED)
        out.open(gap)
        return content(node), out, visible, pre, gap
    return content(node), out, visible, pre, -1


def content(node: Node) -> Iterator:
    if node.tag in ("pre", "listing") and node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
        return iter([node.children[0][1:], *node.children[1:]])
    return iter(node.children)


def indented(node: Node, out: Layout, margin: int) -> Iterator:
    out.open(margin)
    held = out.deeper(4)
    yield from node.children
    out.close(margin)
    out.indent = held


def summary(node: Node, out: Layout, visible: bool) -> Iterator:
    """Closed details show their first summary."""
    out.open(0)
    for child in node.children:
        if isinstance(child, Node) and child.tag == "summary":
            yield child
            break
    out.close(0)


def items(node: Node, out: Layout, visible: bool, pre: bool) -> Iterator:
    gap = int(not out.indent)
    out.open(gap)
    ordered = node.tag == "ol"
    step = -1 if ordered and "reversed" in node.attributes else 1
    count = sum(isinstance(c, Node) and c.tag == "li" for c in node.children)
    number = whole(node.attributes.get("start"), count if step < 0 else 1)
    label = LABELS.get(node.attributes.get("type", ""), str)
    for child in node.children:
        if isinstance(child, str) or child.tag != "li":
            yield child
            continue
        here, seen, _ = shown(child, visible)
        if not here:
            continue
        number = whole(child.attributes.get("value"), number)
        out.flush()
        out.marker = (label(number) + "." if ordered else "•") + " " if seen else ""
        held, before = out.deeper(max(2, len(out.marker))), len(out.lines)
        yield iter(child.children), out, seen, pre, 0
        out.indent, out.marker = held, ""
        if len(out.lines) > before:
            out.margin = 0
        number += step
    out.close(gap)


class Grid:
    """Which columns are free in a row group's next row; spans are ranges, whatever their size."""

    END = 1 << 60

    def __init__(self):
        self.starts, self.ends = [0], [self.END]
        self.held: list[tuple[int, int, int]] = []  # (last row, columns from, to)

    def row(self, r: int) -> None:
        """Frees what ended before row r."""
        while self.held and self.held[0][0] < r:
            _, a, b = heapq.heappop(self.held)
            i = bisect.bisect_left(self.starts, a)
            if i < len(self.starts) and self.starts[i] == b:
                b = self.ends[i]
                del self.starts[i], self.ends[i]
            if i and self.ends[i - 1] == a:
                self.ends[i - 1] = b
            else:
                self.starts.insert(i, a), self.ends.insert(i, b)

    def free(self, c: int) -> int:
        """The first free column from c on."""
        i = bisect.bisect_right(self.starts, c) - 1
        return c if i >= 0 and self.ends[i] > c else self.starts[i + 1]

    def hold(self, a: int, b: int, last: int) -> None:
        """Takes the free ones of columns a to b up to row `last`."""
        i = bisect.bisect_right(self.starts, a) - 1
        i = i if i >= 0 and self.ends[i] > a else i + 1
        while i < len(self.starts) and self.starts[i] < b:
            x, y = self.starts[i], self.ends[i]
            p, q = max(x, a), min(y, b)
            rest = [(s, e) for s, e in ((x, p), (q, y)) if s < e]
            self.starts[i : i + 1], self.ends[i : i + 1] = [s for s, _ in rest], [e for _, e in rest]
            heapq.heappush(self.held, (last, p, q))
            i += len(rest) - (q < y)
            if q < y:
                return


def row_groups(node: Node, visible: bool) -> list[list[tuple[Node, bool]]]:
    """The rows of each row group, the first head before all others and the first foot after them."""
    head, bodies, foot, own = None, [], None, None
    for child in node.children:
        if not isinstance(child, Node) or child.tag not in SECTIONS and child.tag != "tr":
            continue
        here, seen, _ = shown(child, visible)
        if not here:
            continue
        if child.tag == "tr":
            if own is None:
                own = []
                bodies.append(own)
            own.append((child, seen))
            continue
        own = None
        rows = [(r, s) for r in child.children if isinstance(r, Node) and r.tag == "tr" for h, s, _ in (shown(r, seen),) if h]
        if child.tag == "thead" and head is None:
            head = rows
        elif child.tag == "tfoot" and foot is None:
            foot = rows
        else:
            bodies.append(rows)
    return [g for g in (head, *bodies, foot) if g]


def table(node: Node, out: Layout, visible: bool, pre: bool) -> Iterator:
    """The caption, then the rows with their cells in aligned columns."""
    out.open(1)
    for child in node.children:
        if isinstance(child, Node) and child.tag == "caption":
            yield child
    out.close(0)
    rows: list[list[tuple[int, int, list[str]]]] = []  # (column, span, lines) of each cell
    for group in row_groups(node, visible):
        grid = Grid()
        for r, (row, row_seen) in enumerate(group):
            grid.row(r)
            cells, c = [], 0
            for cell in row.children:
                if not isinstance(cell, Node) or cell.tag not in ("td", "th"):
                    continue
                here, seen, _ = shown(cell, row_seen)
                if not here:
                    continue
                if out.depth >= NESTED:
                    out.open(0)
                    yield iter(cell.children), out, seen, pre, 0
                    continue
                span = min(max(1, whole(cell.attributes.get("colspan"), 1)), 1000)
                down = min(max(0, whole(cell.attributes.get("rowspan"), 1)), 65534)
                c = grid.free(c)
                if down != 1:
                    grid.hold(c, c + span, r + down - 1 if down else len(group))
                inner = Layout(out.depth + 1)
                yield iter(cell.children), inner, seen, pre, 0
                cells.append((c, span, inner.lines))
                c += span
            rows.append(cells)
    offset = offsets(rows)
    for cells in rows:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line, width = "", 0
            for c, _, lines in cells:
                if k < len(lines) and lines[k]:
                    gap = offset[c] - width
                    if line or gap > 0:
                        part = " " * max(gap, 2 if line else 0)
                        line, width = line + part, width + len(part)
                    line += lines[k]
                    width += columns(lines[k])
            if line:
                out.add([line])
    out.close(1)


def offsets(rows: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
    """Where each column that a cell starts in begins; columns two apart, those without text take no room."""
    known = sorted({c for cells in rows for c, _, _ in cells})
    place = {c: i for i, c in enumerate(known)}
    widths, wide = [0] * len(known), []
    for cells in rows:
        for c, span, lines in cells:
            width = min(max(map(columns, lines), default=0), WIDEST)
            end = bisect.bisect_left(known, c + span) if span > 1 else place[c] + 1
            if end - place[c] == 1:
                widths[place[c]] = max(widths[place[c]], width)
            elif width:
                wide.append((end - place[c], place[c], end, width))
    for _, a, b, width in sorted(wide):  # a cell over several columns widens the last one, if need be
        room = sum(w + 2 for w in widths[a:b] if w) - 2
        if width > room:
            widths[b - 1] += width - max(room, 0) - (2 if room > 0 and not widths[b - 1] else 0)
            widths[b - 1] = max(widths[b - 1], 1)
    starts = accumulate((w + 2 if w else 0 for w in widths), initial=0)
    return dict(zip(known, starts, strict=False))


def extract(source: str | None) -> str:
    """The visible text of a page."""
    return "\n".join(draw(parse(source or "")))


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines of every row of pages: one pass, no shuffle."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [extract(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], names=["page_id", "text"])

    out = pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, text string")
    return out.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
