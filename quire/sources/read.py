"""Files to documents: Spark lists and reads the files, one kernel per row extracts them where they are.

`content` never leaves the task that read it, so nothing is shuffled; a file that can't be read is a row with an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import prepare
from quire.sources import dom, formats, mail, office, plain

MAX_BYTES = 100 * 1024 * 1024
READERS = {
    "text": plain.read_text, "markdown": plain.read_markdown, "csv": plain.read_csv, "json": plain.read_json, "yaml": plain.read_yaml, "xml": plain.read_xml, "html": dom.read_html,
    "eml": mail.read_eml, "epub": mail.read_epub, "rtf": mail.read_rtf, "xlsx": office.read_xlsx, "docx": office.read_docx, "pptx": office.read_pptx,
}
SCHEMA = "path string, ext string, format string, text string, metadata string, structure string, error_type string, error string"


def extract(data: bytes, ext: str) -> dict:
    """text, metadata and structure of one file's bytes."""
    why = formats.reason(ext)
    if why:
        raise ValueError(why)
    if len(data) > MAX_BYTES:
        raise ValueError(f"the file has {len(data)} bytes; at most {MAX_BYTES} are read")
    reader = formats.FORMATS[ext][0]
    return plain.read_code(data, ext) if reader == "code" else READERS[reader](data)


def parse_files(files: DataFrame) -> DataFrame:
    """SCHEMA for every row (path, content) of files; metadata and structure are JSON."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column("path")[i].as_py(), batch.column("content")[i].as_py()
                ext = formats.suffix(path or "")
                row = [path, ext, formats.FORMATS.get(ext, (None,))[0], None, None, None, None, None]
                try:
                    got = extract(data or b"", ext)
                    facts = {"filename": path.rpartition("/")[2], "file_size": len(data or b""), "file_extension": ext, **got["metadata"]}
                    row[3:6] = got["text"], json.dumps(facts, ensure_ascii=False, default=str), json.dumps(got["structure"], ensure_ascii=False, default=str)
                except Exception as e:  # one bad file is one bad row
                    row[6:] = type(e).__name__, str(e)[:2000]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in row], names=names)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def read_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """Documents of a folder. Files with other extensions than the known ones are rows with an error."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return parse_files((reader.option("pathGlobFilter", pattern) if pattern else reader).load(path))


def parse_bytes(table: DataFrame, content: str = "content", filename: str = "filename") -> DataFrame:
    """Documents from rows of file names and bytes (or base64 strings)."""
    kind = dict(table.dtypes)[content]
    data = F.unbase64(content) if kind == "string" else F.col(content)
    return parse_files(table.select(F.col(filename).alias("path"), data.alias("content")))


def metadata_of(docs: DataFrame, name: str, kind: str = "string"):
    """A metadata field as a column."""
    return F.get_json_object("metadata", f"$.{name}").cast(kind)
