"""A page's element tree: a one-pass tokenizer and a tree builder with implied tags.

The tokenizer reads every character a bounded number of times, whatever the markup. The builder keeps, for every tag and
group of tags, the places of its open elements, so that a question such as "is a paragraph open inside this cell" is one
look at the ends of some lists and no walk of the stack: there is no limit on depth, and time is linear in the source.

The rules are those of HTML parsing where they bear on text: comments end where browsers end them, an open tag at the
end of the source is dropped, raw text ends at its own end tag, content that has no place in a table moves before it,
and SVG and MathML are read as foreign elements. An end tag of a formatting element that holds open blocks leaves them
open, and they stay its children.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

# Fixed values of the HTML standard: element groups.
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("textarea title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SPECIAL = frozenset(
    "address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dialog dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td template textarea tfoot th thead title tr track ul wbr xmp".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p plaintext pre search section summary table ul xmp".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SECTIONS = frozenset("thead tbody tfoot".split())
TABLE_PARTS = frozenset("caption colgroup col tbody tfoot thead tr td th".split())
IN_TABLE = TABLE_PARTS | {"table", "style", "script", "template", "form"}
LEAVES_FOREIGN = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())

#: Groups that the builder asks for, by name; every tag is a group of its own too.
GROUPS = {
    "%scope": SCOPE,
    "%special": SPECIAL,
    "%item": SPECIAL - {"address", "div", "p", "li", "dd", "dt"},
    "%holder": frozenset({"table", "tr", *SECTIONS}),
    "%cell": frozenset({"td", "th", "caption"}),
}
MARKS = {tag: (tag, *(g for g, tags in GROUPS.items() if tag in tags)) for tag in SPECIAL | FORMATTING}

OPENER = re.compile(r"<(?=[a-zA-Z/!?])")
NAME = re.compile(r"[^ \t\n\f/>]+")
ATTRIBUTE = re.compile(r"[ \t\n\f/]*+(?:>|(=?[^ \t\n\f/>=]*+)(?:[ \t\n\f]*+=[ \t\n\f]*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^ \t\n\f>]*+)))?+)")
COMMENT_END = re.compile(r"--!?>")
RAW_END = {tag: re.compile(f"</{tag}(?=[ \\t\\n\\f/>])", re.I | re.A) for tag in RAW | ESCAPABLE}
SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[ \t\n\f/>])", re.I | re.A)
BLANK = re.compile(r"[ \t\n\f]*+\Z")

NONE: dict[str, str] = {}


class Node:
    """An element; children are nodes and texts. NONE stands for no attributes and is never changed."""

    __slots__ = ("tag", "attributes", "children", "foreign")

    def __init__(self, tag: str, attributes: dict[str, str] = NONE, foreign: bool = False):
        self.tag, self.attributes, self.foreign = tag, attributes, foreign
        self.children: list[Node | str] = []


def script_end(source: str, at: int) -> int:
    """Where the end tag of a script that starts at `at` stands; a script inside a comment of the script ends first."""
    commented = inner = False
    while True:
        m = SCRIPT.search(source, at)
        if m is None:
            return len(source)
        at = m.end()
        if m[0] == "<!--":
            commented = commented or not source.startswith((">", "->"), at)
        elif m[0] == "-->":
            commented = inner = False
        elif not m[1]:
            inner = commented
        elif inner:
            inner = False
        else:
            return m.start()


def read_tag(source: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """Name, attributes, whether it closes itself, and end of the tag whose name starts at `at`; end -1: it never closes."""
    m = NAME.match(source, at)
    name, at = m[0].lower(), m.end()
    found = NONE
    while True:
        m = ATTRIBUTE.match(source, at)
        key, at = m[1], m.end()
        if key is None:
            return name, found, source[at - 2] == "/" and m.end() - m.start() > 1, at
        if at >= len(source):
            return name, found, False, -1
        if key:
            if found is NONE:
                found = {}
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            found.setdefault(key.lower(), html.unescape(value) if "&" in value else value)


class Builder:
    """Tokens in, tree out. `at` has the places in the stack of each tag's and each group's open elements."""

    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        self.at: dict[str, list[int]] = {}

    def last(self, *groups: str) -> int:
        """The place of the innermost open element of these groups; 0 (the root) if there is none."""
        return max((places[-1] for g in groups if (places := self.at.get(g))), default=0)

    def push(self, node: Node) -> None:
        for g in self._groups(node):
            self.at.setdefault(g, []).append(len(self.stack))
        self.stack.append(node)

    def _groups(self, node: Node) -> tuple[str, ...]:
        if node.foreign:
            return "%foreign", "%foreign " + node.tag
        found = MARKS.get(node.tag) or (node.tag,)
        return (*found, "%html") if self.at.get("%foreign") else found

    def pop_to(self, size: int) -> None:
        """Ends the open elements from place `size` on."""
        while len(self.stack) > size:
            node = self.stack.pop()
            for g in self._groups(node):
                places = self.at.get(g)
                if places and places[-1] == len(self.stack):  # else it was ended before, in the middle of the stack
                    places.pop()

    def parse(self, source: str) -> Node:
        source = source.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
        at, size = 0, len(source)
        while at < size:
            m = OPENER.search(source, at)
            end = m.start() if m else size
            if end > at:
                self.text(source[at:end])
            if m is None:
                break
            at = self.markup(source, end)
        return self.root

    def markup(self, source: str, at: int) -> int:
        """Reads the tag or comment at `at`; returns where what follows starts."""
        size, kind = len(source), source[at + 1]
        if kind == "!":
            if source.startswith("--", at + 2):
                if source.startswith((">", "->"), at + 4):
                    return source.index(">", at) + 1
                m = COMMENT_END.search(source, at + 4)
                return m.end() if m else size
            if source.startswith("[CDATA[", at + 2) and self.stack[-1].foreign:
                end = source.find("]]>", at)
                self.text(source[at + 9 : end if end >= 0 else size], raw=True)
                return end + 3 if end >= 0 else size
            return self._past(source, at)
        if kind == "?":
            return self._past(source, at)
        if kind == "/":
            if at + 2 == size:
                self.text("</")
                return size
            c = source[at + 2]
            if not (c.isascii() and c.isalpha()):
                return self._past(source, at)
            name, _, _, end = read_tag(source, at + 2)
            if end < 0:
                return size
            self.end(name)
            return end
        name, attributes, closed, end = read_tag(source, at + 1)
        if end < 0:
            return size
        node = self.start(name, attributes, closed)
        if node is None or node.foreign:
            return end
        if name == "plaintext":
            node.children.append(source[end:])
            return size
        if name in RAW or name in ESCAPABLE:
            if name == "script":
                stop = script_end(source, end)
            else:
                m = RAW_END[name].search(source, end)
                stop = m.start() if m else size
            inner = source[end:stop]
            if name in ESCAPABLE:
                inner = html.unescape(inner.removeprefix("\n") if name == "textarea" else inner)
            node.children.append(inner)
            return self._past(source, stop) if stop < size else size
        return end

    @staticmethod
    def _past(source: str, at: int) -> int:
        end = source.find(">", at)
        return end + 1 if end >= 0 else len(source)

    def _astray(self) -> bool:
        """Whether the current element is a table, or a part of one, that holds no text of its own."""
        node = self.stack[-1]
        return not node.foreign and (node.tag == "table" or node.tag == "tr" or node.tag in SECTIONS) and self.last("table") > 0

    def _put(self, child: Node | str, stray: bool) -> None:
        """Adds to the current element, or before the open table, which is its parent's last child."""
        if not stray:
            self.stack[-1].children.append(child)
            return
        place = self.last("table")
        siblings = self.stack[place - 1].children
        if siblings and siblings[-1] is self.stack[place]:
            siblings.insert(len(siblings) - 1, child)
        else:  # the table itself was moved; its text follows it
            siblings.append(child)

    def text(self, text: str, raw: bool = False) -> None:
        if not raw and "&" in text:
            text = html.unescape(text)
        blank = BLANK.match(text) is not None
        top = self.stack[-1]
        if not blank:
            if top.tag == "head":
                self.pop_to(len(self.stack) - 1)
            elif top.tag == "colgroup":
                self.pop_to(len(self.stack) - 1)
        self._put(text, not blank and self._astray())

    def start(self, tag: str, attributes: dict[str, str], closed: bool) -> Node | None:
        """Opens an element, after what its start tag ends or opens by itself; None if the tag counts for nothing."""
        parent = self.stack[-1]
        if parent.foreign and parent.tag not in INTEGRATION:
            if not (tag in LEAVES_FOREIGN or tag == "font" and attributes.keys() & {"color", "face", "size"}):
                return self._foreign(tag, attributes, closed)
            self._leave_foreign()
        if tag in ("svg", "math"):
            self._head_ends(tag)
            return self._foreign(tag, attributes, closed)
        self._head_ends(tag)
        if tag in ("html", "head", "body", "frame", "frameset"):
            if tag in ("html", "head", "body") and self.stack[-1].tag in ("#root", "html") and not self.at.get(tag) and not self.at.get("body"):
                node = Node(tag, attributes)
                self._put(node, False)
                self.push(node)
            return None
        if tag in TABLE_PARTS:
            if not self._table_context(tag):
                return None
        elif tag == "table" and self.last("table") > self.last("%cell", "template", "%foreign"):
            if self._astray():
                self.pop_to(self.last("table"))
        elif self.stack[-1].tag == "colgroup" and tag != "template":
            self.pop_to(len(self.stack) - 1)
        stray = self._astray() and tag not in IN_TABLE and not (tag == "input" and attributes.get("type", "").lower() == "hidden")
        if tag == "form":
            if self.at.get("form") and self.last("form") > self.last("template") or self._astray():
                return None  # a form in a form, or around rows or cells, holds nothing
        self._implied(tag)
        node = Node(tag, attributes)
        self._put(node, stray)
        if tag not in VOID and tag not in RAW and tag not in ESCAPABLE and tag != "plaintext":
            self.push(node)
        return node

    def _head_ends(self, tag: str) -> None:
        if self.stack[-1].tag == "head" and tag not in IN_HEAD:
            self.pop_to(len(self.stack) - 1)

    def _foreign(self, tag: str, attributes: dict[str, str], closed: bool) -> Node:
        node = Node(tag, attributes, True)
        self._put(node, self._astray())
        if not closed:
            self.push(node)
        return node

    def _leave_foreign(self) -> None:
        while self.stack[-1].foreign and self.stack[-1].tag not in INTEGRATION:
            self.pop_to(len(self.stack) - 1)

    def _table_context(self, tag: str) -> bool:
        """Ends what stands between the open table and a part of it, and opens the row that a cell lacks."""
        place = self.last("%holder") if tag in ("td", "th") else self.last("table", *SECTIONS) if tag == "tr" else self.last("table")
        if tag == "col" and self.stack[-1].tag == "colgroup":
            return True
        if not place or place < self.last("template", "%foreign"):
            return False
        self.pop_to(place + 1)
        if tag in ("td", "th") and self.stack[-1].tag != "tr":
            row = Node("tr")
            self._put(row, False)
            self.push(row)
        return True

    def _implied(self, tag: str) -> None:
        """Ends the elements that a start tag ends."""
        if tag in ("li", "dd", "dt"):
            own, other = (("li",), ("dd", "dt")) if tag == "li" else (("dd", "dt"), ("li",))
            place = self.last(*own)
            if place > self.last("%item", "%foreign", *other):
                self.pop_to(place)
        if tag in ENDS_P:
            p = self.last("p")
            if p > self.last("%scope", "button", "%foreign"):
                self.pop_to(p)
        if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        elif tag == "option" and self.stack[-1].tag == "option":
            self.pop_to(len(self.stack) - 1)
        elif tag == "optgroup":
            for inner in ("option", "optgroup"):
                if self.stack[-1].tag == inner:
                    self.pop_to(len(self.stack) - 1)
        elif tag == "button":
            b = self.last("button")
            if b > self.last("%scope", "%foreign"):
                self.pop_to(b)
        elif tag in ("rb", "rt", "rtc", "rp") and self.stack[-1].tag in ("rb", "rt", "rp"):
            self.pop_to(len(self.stack) - 1)

    def end(self, tag: str) -> None:
        top = self.stack[-1]
        if top.foreign:
            place = self.last("%foreign " + tag)
            if place > self.last("%html"):
                self.pop_to(place)
                return
        if tag == "br":
            self.start("br", NONE, False)
            return
        if tag == "p":
            if self.last("p") <= self.last("%scope", "button", "%foreign"):
                self.start("p", NONE, False)
            self.pop_to(self.last("p"))
            return
        if tag in ("html", "body") or tag in VOID:
            return
        place = self.last(*HEADINGS) if tag in HEADINGS else self.last(tag)
        if not place:
            return
        if tag in FORMATTING:
            if place < self.last("%scope", "%foreign"):
                return
            if place < self.last("%special"):
                self.at[tag].pop()  # ended, while blocks in it stay open
                return
        elif tag == "table" or tag in TABLE_PARTS:
            if place < self.last("table") or place < self.last("template", "%foreign"):
                return
        elif tag == "template" or tag == "head":
            pass
        elif tag == "li":
            if place < self.last("%scope", "ol", "ul", "%foreign"):
                return
        elif tag in SPECIAL:
            if place < self.last("%scope", "%foreign"):
                return
        elif place < self.last("%special", "%foreign"):
            return
        self.pop_to(place)


def parse(source: str) -> Node:
    return Builder().parse(source)


def walk(node: Node) -> Iterator[Node | str]:
    """All of node's descendants in document order, without recursion."""
    stack = [iter(node.children)]
    while stack:
        for child in stack[-1]:
            yield child
            if isinstance(child, Node):
                stack.append(iter(child.children))
                break
        else:
            stack.pop()
