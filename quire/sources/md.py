"""Markdown pieces that the readers share."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from itertools import groupby
from typing import NamedTuple

ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def one_line(text: str) -> str:
    return " ".join(text.split())


def heading(text: str, level: int) -> str:
    return "#" * sorted((1, level, 6))[1] + " " + one_line(text)


def roman(n: int) -> str:
    if n <= 0:
        return str(n)
    out = ""
    for value, sign in ROMAN:
        count, n = divmod(n, value)
        out += sign * count
    return out


def letters(n: int) -> str:
    if n <= 0:
        return str(n)
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(97 + rest) + out
    return out


#: Number formats by the names that word processors use.
NUMBERS = {
    "decimal": str, "decimalZero": lambda n: f"{n:02d}", "lowerLetter": letters, "upperLetter": lambda n: letters(n).upper(), "lowerRoman": roman, "upperRoman": lambda n: roman(n).upper(),
}


def marker(kind: str, n: int = 1, suffix: str = ".") -> str:
    return NUMBERS[kind](n) + (suffix if suffix in (".", ")") else ".") if kind in NUMBERS else "-"


def list_item(text: str, depth: int, mark: str) -> str:
    """One item; its further lines stand below its first character."""
    first, *rest = text.split("\n")
    indent = "  " * max(depth, 0)
    pad = indent + " " * (len(mark) + 1)
    return "\n".join([f"{indent}{mark} {first}".rstrip(), *(pad + line if line.strip() else "" for line in rest)])


def cell(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n").strip()
    return re.sub(r"[ \t]*\n[ \t]*", "<br>", re.sub(r"(?<!\\)\|", r"\\|", text))


def table(rows: Iterable[Sequence[str]], header: bool = True) -> str:
    """A pipe table; without a header its header row is empty."""
    body = [[cell(str(c)) for c in row] for row in rows if len(row)]
    if not body:
        return ""
    width = max(map(len, body))
    body = [row + [""] * (width - len(row)) for row in body]
    if not header:
        body.insert(0, [""] * width)
    body.insert(1, ["---"] * width)
    return "\n".join("| " + " | ".join(row) + " |" for row in body)


class Grid:
    """Cells with spans: a value stands in the first free column of its row, the rest of its span stays empty."""

    def __init__(self):
        self.values: dict[tuple[int, int], str] = {}
        self.taken: set[tuple[int, int]] = set()
        self.height = self.width = 0

    def put(self, row: int, text: str, down: int = 1, across: int = 1) -> None:
        col = next(c for c in range(len(self.taken) + 1) if (row, c) not in self.taken)
        self.taken |= {(row + i, col + j) for i in range(max(down, 1)) for j in range(max(across, 1))}
        self.values[row, col] = text
        self.height, self.width = max(self.height, row + 1), max(self.width, col + max(across, 1))

    def rows(self) -> list[list[str]]:
        return [[self.values.get((r, c), "") for c in range(self.width)] for r in range(self.height)]


class Run(NamedTuple):
    text: str
    bold: bool = False
    italic: bool = False
    href: str | None = None
    code: bool = False
    strike: bool = False


def around(text: str, mark: str) -> str:
    """mark on both sides of text, its outer white space left outside."""
    core = text.strip()
    return text.replace(core, mark + core + mark, 1) if core and mark else text


def code_span(text: str) -> str:
    if not text.strip():
        return text
    ticks = "`"
    while ticks in text:
        ticks += "`"
    pad = " " if "`" in (text[0], text[-1]) else ""
    return ticks + pad + text + pad + ticks


def link(text: str, href: str | None) -> str:
    core = text.strip()
    if not href or not core:
        return text
    for raw, safe in ((" ", "%20"), (")", "%29"), ("(", "%28")):
        href = href.strip().replace(raw, safe)
    return text.replace(core, f"[{core}]({href})", 1)


def formatted(r: Run) -> str:
    text = code_span(r.text) if r.code else r.text
    text = around(text, "~~" if r.strike else "")
    return around(text, "***" if r.bold and r.italic else "**" if r.bold else "*" if r.italic else "")


def inline(runs: Iterable[Run]) -> str:
    """Runs of one format are joined first, and white space joins the run before it; links may hold several runs."""
    joined: list[Run] = []
    for r in runs:
        if not r.text:
            continue
        before = joined[-1] if joined else None
        if before and (before[1:] == r[1:] or not (r.text.strip() or r.href or r.code or before.href)):
            joined[-1] = before._replace(text=before.text + r.text)
        else:
            joined.append(r)
    return "".join(link("".join(map(formatted, group)), href) if href else "".join(map(formatted, group)) for href, group in ((h, list(g)) for h, g in groupby(joined, lambda r: r.href or None)))


class Page:
    """Blocks with one blank line between them; items of a list stand together."""

    def __init__(self):
        self.blocks: list[str] = []
        self.listing = False

    def block(self, text: str | None) -> None:
        if text and text.strip():
            self.blocks.append(text.strip("\n"))
            self.listing = False

    def item(self, line: str) -> None:
        if not line.strip():
            return
        if self.listing:
            self.blocks[-1] += "\n" + line.rstrip()
        else:
            self.blocks.append(line.rstrip())
        self.listing = True

    def text(self) -> str:
        return "\n\n".join(self.blocks)


class Depth:
    """Nesting depth from source levels that may leave some out."""

    def __init__(self):
        self.open: list[int] = []

    def of(self, level: int) -> int:
        self.open = [x for x in self.open if x <= level]
        if level not in self.open[-1:]:
            self.open.append(level)
        return len(self.open) - 1

    def reset(self) -> None:
        self.open = []


def human_size(n: int) -> str:
    if n < 1024:
        return f"{n} bytes"
    for unit, size in (("KB", 1024), ("MB", 1024**2)):
        if n < size * 1024:
            return f"{n / size:.1f} {unit}"
    return f"{n / 1024**3:.1f} GB"


def fenced(body: str, language: str = "") -> str:
    fence = "```"
    while fence in body:
        fence += "`"
    return f"{fence}{language}\n{body}\n{fence}"
