"""Chunks of parsed files that follow their format: code, tables, workbooks, web pages, slides.

Input rows are documents as the reader gives them (path, ext, format, text, structure as JSON). One kernel looks at each
document's structure; nothing is shuffled.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.functions.splitting import chunks_of, packed, units_of
from quire.operators.chunking import CHUNK_SIZE, OVERLAP, check_options, code_windows

ROWS = 100
SCHEMA = "path string, chunk_id int, text string, start_char int, end_char int, section_type string, section_name string, chunk_strategy string, details string"


def piece(text: str, strategy: str, start: int | None = 0, kind: str = "text", name: str | None = None, **details) -> dict:
    body = text.strip() if kind in ("imports", "function", "class") else text
    return {"text": body, "start_char": start, "end_char": None if start is None else start + len(text), "section_type": kind, "section_name": name, "chunk_strategy": strategy, "details": {k: v for k, v in details.items() if v is not None}}


def code_pieces(text: str, structure: dict, size: int, overlap: int) -> list[dict]:
    """The imports' lines, then functions, then classes; longer ones (in characters) in windows that end after lines."""
    lines = text.splitlines()
    out = []
    imports = [i["line"] for i in structure.get("imports", [])]
    head = "\n".join(lines[: max(imports, default=0)])
    if head.strip():
        out.append(piece(head, "imports", kind="imports", line_start=1, line_end=max(imports)))
    for kind in ("function", "class"):
        for item in structure.get(kind + ("es" if kind == "class" else "s"), []):
            body = "\n".join(lines[item["line_start"] - 1 : item["line_end"]])
            if len(body) <= size:
                if body.strip():
                    out.append(piece(body, kind, kind=kind, name=item["name"], line_start=item["line_start"], line_end=item["line_end"], docstring=item.get("docstring"), methods=item.get("methods")))
                continue
            out += [piece(body[s:e], f"{kind}_split", s, kind, item["name"], part=n) for n, (s, e) in enumerate(code_windows(body, size, overlap), 1)]
    return out or [piece(text[s:e], "simple", s) for s, e in code_windows(text, size, overlap)]


def row_runs(rows: list[str], header: str | None, first: int) -> Iterator[tuple[int, int, str]]:
    """(first row, last row, text) of runs of ROWS rows under the header; rows count from 1."""
    for start in range(first, len(rows), ROWS):
        part = rows[start : start + ROWS]
        yield start + 1, start + len(part), "\n".join([header, *part] if header else part)


def csv_pieces(text: str, metadata: dict) -> list[dict]:
    """One chunk up to ROWS data rows; beyond, runs of text lines that repeat line 0. The rule line counts as a row."""
    if metadata["num_rows"] <= ROWS:
        return [piece(text, "csv", kind="table", num_rows=metadata["num_rows"], column_names=metadata["column_names"])]
    rows = text.split("\n")
    header = rows[0] if metadata["has_header"] else None
    return [piece(body, "by_rows", None, "table", row_start=a, row_end=b) for a, b, body in row_runs(rows, header, int(header is not None))]


def html_table(rows: list[list[str]], header: bool, caption: str | None = None) -> str:
    cells = lambda row, tag: "<tr>" + "".join(f"<{tag}>{html.escape(str(c), quote=False)}</{tag}>" for c in row) + "</tr>"
    lines = ["<table>"] + ([f"<caption>{html.escape(caption, quote=False)}</caption>"] if caption else [])
    if header and rows:
        lines += ["<thead>", cells(rows[0], "th"), "</thead>"]
        rows = rows[1:]
    return "\n".join([*lines, "<tbody>", *(cells(r, "td") for r in rows), "</tbody>", "</table>"])


def grid_rows(grid: str) -> list[list[str]]:
    """Cells of a pipe table, its rule line left out."""
    out = []
    for n, line in enumerate(grid.split("\n")):
        if n != 1 and line.startswith("|"):
            marked = line.strip()[1:-1].replace("\\|", "\0")
            out.append([c.strip().replace("\0", "|") for c in marked.split("|")])
    return out


def workbook_pieces(structure: dict, metadata: dict) -> list[dict]:
    """By sheet if there are several; else by table, or by rows if the one table has more than ROWS of them."""
    sheets = structure.get("sheets", [])
    if not sheets:
        return []
    only = sheets[0]
    tables = only["tables"]
    if metadata.get("has_multiple_sheets"):
        plan = "by_sheet"
    elif len(tables) == 1:
        t = tables[0]
        plan = "by_rows" if t["end_row"] - t["start_row"] + (t["header_row"] is None) > ROWS else "by_table"
    else:
        plan = "by_table" if tables else "by_rows" if only["max_row"] > ROWS else "by_sheet"
    out = []
    for s in sheets:
        rows = grid_rows(s["text"])
        facts = {"sheet_index": s["sheet_index"]}
        if plan == "by_sheet":
            out.append(piece(html_table(rows, True), plan, None, "table", s["sheet_name"], num_rows=s["max_row"], num_columns=s["max_column"], num_tables=len(s["tables"]), **facts))
        elif plan == "by_table":
            for i, t in enumerate(s["tables"]):
                part = [r[t["start_col"] - 1 : t["end_col"]] for r in rows[t["start_row"] - 1 : t["end_row"]]]
                out.append(piece(html_table(part, t["header_row"] is not None), plan, None, "table", s["sheet_name"], table_index=i, **facts))
        else:
            lines = ["\t".join(r) for r in rows]
            out += [piece(body, plan, None, "table", s["sheet_name"], row_start=a, row_end=b, **facts) for a, b, body in row_runs(lines, lines[0], 1)]
    return out


def page_pieces(text: str, structure: dict, metadata: dict, size: int, overlap: int) -> list[dict]:
    """Semantic sections, headings or sizes, whichever the page has; tables once more as HTML."""
    sections = structure.get("sections", [])
    out: list[dict] = []
    if len(sections) >= 3 and any(s["tag"] in ("article", "section", "aside") for s in sections):
        cursor = 0
        for s in sections:
            body = s["text"] if not s["heading"] or s["text"].lstrip().startswith(s["heading"]) else f"{s['heading']}\n\n{s['text']}"
            units = units_of(body, size)
            for i, j in packed(units, size, overlap):
                part = body[units[i].start : units[j - 1].end]
                at = text.find(part, cursor)
                at = text.find(part) if at < 0 else at
                cursor = at if at >= 0 else cursor
                out.append(piece(part, "semantic", at if at >= 0 else units[i].start, name=s["heading"], section_tag=s["tag"], section_index=s["section_index"], heading_level=s["heading_level"], offsets="text" if at >= 0 else "section"))
    else:
        level, plan = (6, "structural") if metadata.get("num_headings", 0) >= 5 else (0, "fixed_size")
        out = [piece(c["text"], plan, c["start_char"], name=c["section_name"], heading_path=c["heading_path"]) for c in chunks_of(text, size, overlap, level, plan)]
    for t in structure.get("tables", []):
        rows = [t["headers"], *t["rows"]] if t["headers"] else t["rows"]
        out.append(piece(html_table(rows, bool(t["headers"]), t["caption"]), "table", None, "table", t["caption"], table_index=t["table_index"], num_rows=len(t["rows"]), offsets="none"))
    return out


def slide_pieces(structure: dict) -> list[dict]:
    out = []
    for s in structure.get("slides", []):
        title = next((c["text"] for c in s["content"] if c["type"] == "title"), None)
        notes = "\n".join(c["text"] for c in s["content"] if c["type"] == "notes")
        parts = [f"## Slide {s['slide_number']}" + (f": {title}" if title else ""), *(c["text"] for c in s["content"] if c["type"] not in ("title", "notes")), f"### Notes\n\n{notes}" if notes else ""]
        out.append(piece("\n\n".join(p for p in parts if p), "slide", None, "slide", title, slide_number=s["slide_number"]))
    return out


def pieces(fmt: str, ext: str, text: str, structure: dict, metadata: dict, size: int, overlap: int) -> list[dict]:
    if fmt == "code":
        return code_pieces(text, structure, size, overlap)
    if fmt == "csv":
        return csv_pieces(text, metadata)
    if fmt == "xlsx":
        return workbook_pieces(structure, metadata)
    if fmt == "html":
        return page_pieces(text, structure, metadata, size, overlap)
    if fmt == "pptx":
        return slide_pieces(structure)
    level = {".md": 6, ".markdown": 6, ".docx": 1, ".doc": 1}.get(ext, 0)
    return [piece(c["text"], c["chunk_strategy"], c["start_char"], name=c["section_name"], heading_path=c["heading_path"]) for c in chunks_of(text, size, overlap, level, fmt if level else "recursive")]


def chunk_files(docs: DataFrame, chunk_size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """SCHEMA: chunks of documents by the rules of their format; documents with errors have none."""
    check_options("auto", chunk_size, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        types = {"int": pa.int32(), "string": pa.string()}
        for batch in batches:
            for i in range(batch.num_rows):
                d = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                found = pieces(d["format"], d["ext"], d["text"], json.loads(d["structure"] or "{}"), json.loads(d["metadata"] or "{}"), chunk_size, overlap)
                rows = [{"path": d["path"], "chunk_id": n, **p, "details": json.dumps(p["details"], ensure_ascii=False)} for n, p in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[c.split()[1]]) for n, c in zip(names, SCHEMA.split(", "), strict=True)], names=names)

    return docs.where("text IS NOT NULL").select("path", "ext", "format", "text", "structure", "metadata").mapInArrow(run, SCHEMA)
