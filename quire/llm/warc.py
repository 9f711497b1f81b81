"""WARC archives with a two-level capture index.

Writing: every page becomes one WARC 1.1 record, a gzip member of its own. Of pages with equal payloads (of `least`
bytes or more) the one with the smallest page_id is the response; the others are revisit records, which hold the
HTTP head only and name the response. Each task writes an archive under a new name and returns one index row a record;
only rows of tasks that succeeded reach the index, so files of lost attempts are never read.

Index: rows are sorted by reversed-host URL key and page_id into range partitions. Each partition is a file of
gzip blocks of `BLOCK` lines followed by its sparse directory (first key, offset, length of each block) and a trailer; the
top level is one first key a file. A look-up searches the top level, one file's directory and one block by bisection,
and then reads one byte range of the archive. All captures of a URL, a host or a domain are ranges of the sort order.
The number of files follows the rows, PART to a file, so that no task's share and no directory grows with the crawl.

Defined results: a null html is an empty payload; a null url has the key ")"; rows that share a page_id and a payload
are all responses if that page_id is the smallest; a null page_id sorts before all others; page_id must be a whole number; further columns are ignored.
Files are opened through pyarrow.fs, so the shared folder may be any file system that it knows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import open_folder, require_whole, slices, staged, staged_path, with_group

BLOCK = 512
#: Captures of an index file, and of a task that looks captures up.
PART = 10_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
LINES = "key string, page_id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels reversed and joined by commas, then the rest of the URL: pages of a domain sort together."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return f"){url}"
    if host.startswith("www."):
        host = host[4:]
    rest = (parts.path or "/" * bool(host)) + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + rest.lower()


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record, not compressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """headers (lower-case names), http head and payload of one record; checks the payload's digest and length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    stated = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != size or digest(payload) != stated):
        raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
    return {"headers": headers, "http": http, "payload": payload, "payload_bytes": size, "payload_digest": stated}


def gzip_member(data: bytes, level: int = 6) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def gunzip_member(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


def page_number(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "None" else int(found)


def record_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, refers_to (null: a response) for every row of pages."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("payload"))
    slim = rows.select("page_id", "payload").distinct()  # repeated rows say the same
    first = with_group(slim, ["payload"], ["page_id"], F.struct(F.col("page_id").alias("id")))
    again = first.where(~F.col("page_id").eqNullSafe(F.col("least.id"))).select("page_id", "payload", F.col("least.id").alias("refers_to"), F.lit(True).alias("again"))
    joined = rows.alias("r").join(again.alias("a"), F.col("r.page_id").eqNullSafe(F.col("a.page_id")) & (F.col("r.payload") == F.col("a.payload")), "left")
    big = F.octet_length("r.html") >= least
    return joined.select("r.page_id", "r.url", "r.html", (F.coalesce("a.again", F.lit(False)) & big).alias("revisit"), F.when(big, F.col("a.refers_to")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes the archives into folder; a table of LINES with one row a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        files.create_dir(base)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for part in slices(batch, "html"):
                if out is None:
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                rows = []
                for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    member = gzip_member(record(page_id, url, html.encode("utf-8"), refers_to, revisit))
                    out.write(member)
                    rows.append((url_key(url), page_id, name, at, len(member)))
                    at += len(member)
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return staged(record_types(pages, least).mapInArrow(run, LINES), "warc-lines")


def sort_key(key: str, page_id: int | None) -> str:
    """Sorts by key, then page_id; no key holds the separator, a control character that URLs can't contain."""
    return f"{key}\x01" + ("" if page_id is None else f"{page_id + (1 << 63):020d}")


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART))


def write_index(lines: DataFrame, folder: str, parts: int | None = None) -> list[tuple[str, str]]:
    """Writes the sorted, blocked index; the top level: (first sort key, file) of each range partition, in order.

    The top level has one entry for PART captures, unless `parts` says otherwise: 25 MB for 2.5 billion captures.
    """
    parts = parts or parts_for(lines.count())
    order = F.concat("key", F.lit("\x01"), F.coalesce(F.lpad((F.col("page_id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.lit("")))
    ordered = lines.select(order.alias("sort"), "file", "offset", "length").repartitionByRange(parts, "sort").sortWithinPartitions("sort")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = open_folder(folder)
        files.create_dir(base)
        name, out, at = f"{uuid.uuid4().hex}.cdx", None, 0
        waiting, directory = [], []

        def flush():
            nonlocal at
            block = gzip_member("\n".join(json.dumps(x, ensure_ascii=False) for x in waiting).encode("utf-8"))
            out.write(block)
            directory.append([waiting[0][0], at, len(block)])
            at += len(block)
            waiting.clear()

        for batch in batches:
            for line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = files.open_output_stream(f"{base}/{name}", compression=None)
                waiting.append(line)
                if len(waiting) == BLOCK:
                    flush()
        if out is None:
            return
        if waiting:
            flush()
        tail = gzip_member(json.dumps(directory, ensure_ascii=False).encode("utf-8"))
        out.write(tail + len(tail).to_bytes(8, "little"))
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([name])], names=["first", "file"])

    top = staged(ordered.mapInArrow(run, "first string, file string"), "warc-top")
    return [(r["first"], r["file"]) for r in top.orderBy("first").collect()]


class CaptureIndex:
    """Look-ups in one task: the last directory, block and archive stay open, as sorted look-ups mostly stay in them."""

    def __init__(self, folder: str, top: list[tuple[str, str]]):
        self.files, self.base = open_folder(folder)
        self.firsts, self.names = [t[0] for t in top], [t[1] for t in top]
        self.part = self.block_at = None
        self.open: tuple[str, pa.NativeFile] | None = None

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if self.open is None or self.open[0] != name:
            if self.open:
                self.open[1].close()
            self.open = name, self.files.open_input_file(f"{self.base}/{name}")
        return self.open[1].read_at(length, offset)

    def lines(self, sort: str) -> list[list]:
        """The index lines of exactly this sort key. Repeated rows may run over the ends of blocks and files."""
        found = []
        p = max(0, bisect.bisect_left(self.firsts, sort) - 1)
        while p < len(self.firsts) and self.firsts[p] <= sort:
            if self.part != p:
                self._load(p)
            b = max(0, bisect.bisect_left(self.block_firsts, sort) - 1)
            while b < len(self.directory) and self.block_firsts[b] <= sort:
                rows, keys = self._block(p, b)
                i = bisect.bisect_left(keys, sort)
                while i < len(keys) and keys[i] == sort:
                    found.append(rows[i])
                    i += 1
                b += 1
            p += 1
        return found

    def _load(self, p: int) -> None:
        path = f"{self.base}/{self.names[p]}"
        size = self.files.get_file_info(path).size
        with self.files.open_input_file(path) as f:
            tail = int.from_bytes(f.read_at(8, size - 8), "little")
            self.directory = json.loads(gunzip_member(f.read_at(tail, size - 8 - tail)))
        self.block_firsts = [d[0] for d in self.directory]
        self.part, self.block_at = p, None

    def _block(self, p: int, b: int):
        if self.block_at != (p, b):
            _, offset, length = self.directory[b]
            with self.files.open_input_file(f"{self.base}/{self.names[p]}") as f:
                rows = [json.loads(x) for x in gunzip_member(f.read_at(length, offset)).decode("utf-8").split("\n")]
            self.block_at, self.block = (p, b), (rows, [r[0] for r in rows])
        return self.block

    def between(self, low: str, high: str) -> Iterator[list]:
        """The index lines with low <= sort key < high, in order; one block is held at a time."""
        p = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while p < len(self.firsts) and self.firsts[p] < high:
            if self.part != p:
                self._load(p)
            b = max(0, bisect.bisect_left(self.block_firsts, low) - 1)
            while b < len(self.directory) and self.block_firsts[b] < high:
                rows, keys = self._block(p, b)
                yield from rows[bisect.bisect_left(keys, low) : bisect.bisect_left(keys, high)]
                if self.part != p:  # another look-up came in between
                    self._load(p)
                b += 1
            p += 1

    def _read(self, ranges: list[tuple[str, str]]) -> Iterator[dict]:
        for low, high in ranges:
            for _, name, offset, length in self.between(low, high):
                yield parse_record(gunzip_member(self._range(name, offset, length)))

    def of_url(self, url: str | None) -> Iterator[dict]:
        """All captures of a URL, by page_id."""
        key = url_key(url)
        return self._read([(f"{key}\x01", f"{key}\x02")])

    def of_host(self, host: str) -> Iterator[dict]:
        """All captures of a host, on any port."""
        key = url_key(f"http://{host}").split(")")[0]
        return self._read([(f"{key})", f"{key}*"), (f"{key}:", f"{key};")])

    def of_domain(self, domain: str) -> Iterator[dict]:
        """All captures of a domain and of the hosts below it."""
        key = url_key(f"http://{domain}").split(")")[0]
        return self._read([(f"{key})", f"{key}*"), (f"{key},", f"{key}-"), (f"{key}:", f"{key};")])

    def captures(self, url: str | None, page_id: int | None) -> list[dict]:
        return [parse_record(gunzip_member(self._range(name, offset, length))) for _, name, offset, length in self.lines(sort_key(url_key(url), page_id))]


def look_up(wanted: DataFrame, folder: str, top: list[tuple[str, str]], parts: int | None = None, with_payload: bool = False) -> DataFrame:
    """The captures of each row (page_id, url) of wanted, read from the archives: sorted look-ups by range."""
    columns = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    names = [c.split()[0] for c in columns.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CaptureIndex(folder, top)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for page_id, url in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    for c in index.captures(url, page_id):
                        h = c["headers"]
                        rows.append((page_number(h["warc-record-id"]), c["payload_bytes"], c["payload_digest"], h["warc-type"], page_number(h["warc-refers-to"]) if "warc-refers-to" in h else None, c["payload"]))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    parts = parts or parts_for(wanted.count())
    host = F.split(F.coalesce("url", F.lit("")), "/")
    near = F.concat_ws(",", F.reverse(F.split(F.regexp_replace(F.coalesce(F.get(host, F.lit(2)), F.lit("")), "^www\\.", ""), "\\.")))
    keyed = wanted.select("page_id", "url", near.alias("near"))
    ordered = keyed.repartitionByRange(parts, "near", "url", "page_id").sortWithinPartitions("near", "url", "page_id")
    return ordered.select("page_id", "url").mapInArrow(run, columns)


def round_trip(pages: DataFrame, least: int = 0, parts: int | None = None) -> DataFrame:
    """Writes pages as archives with their index, then reads every page's record back through the index."""
    require_whole(pages, "page_id")
    spark = pages.sparkSession
    folder = staged_path(spark, "warc")
    lines = write_archives(pages, folder, least)
    top = write_index(lines, folder, parts)
    # each (url, page_id) once: a look-up returns all its records
    parts = parts or parts_for(lines.count())
    return look_up(pages.select("page_id", "url").distinct(), folder, top, parts)
