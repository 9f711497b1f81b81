"""The library's functions: tables in, tables out, under the names of what they do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chunking, enrich, render
from quire.sources import formats
from quire.sources.read import parse_bytes as _parse_bytes
from quire.sources.read import parse_files, read_files

__all__ = ["Pipeline", "batch", "chunk", "extract_metadata", "get_format", "is_supported", "list_formats", "parse", "parse_bytes", "render_prompt"]

OCR_MODES, TABLE_FORMATS = ("auto", "off", "force"), ("markdown", "html")
MOST_FILES = 500


def check_read_options(ocr: str = "auto", table_format: str = "markdown") -> None:
    if ocr not in OCR_MODES:
        raise ValueError(f"Unknown ocr mode: {ocr!r}. Use one of: {', '.join(OCR_MODES)}.")
    if table_format not in TABLE_FORMATS:
        raise ValueError(f"Unknown table_format: {table_format!r}. Use one of: {', '.join(TABLE_FORMATS)}.")


def _cut(docs: DataFrame, max_chars: int | None) -> DataFrame:
    """Text of at most max_chars; counts are of what is left."""
    if max_chars is not None and max_chars < 1:
        raise ValueError(f"max_chars must be positive, got {max_chars!r}.")
    text = F.substring("text", 1, max_chars) if max_chars else F.col("text")
    cut = docs.withColumn("text", text)
    return cut.withColumn("word_count", T.word_count("text")).withColumn("char_count", F.length("text").cast("long"))


def parse(spark: SparkSession, path: str, max_chars: int | None = None, ocr: str = "auto", table_format: str = "markdown") -> DataFrame:
    """Documents of a file or folder, one row each; unreadable files have an error.

    Pictures aren't read and tables are Markdown: other modes are refused rather than ignored.
    """
    check_read_options(ocr, table_format)
    if ocr == "force":
        raise NotImplementedError("ocr='force': there is no text recognition here.")
    if table_format != "markdown":
        raise NotImplementedError("table_format='html': tables of parsed documents are Markdown; format_chunks.html_table renders rows as HTML.")
    return _cut(read_files(spark, path), max_chars)


def parse_bytes(table: DataFrame, content: str = "content", filename: str = "filename", max_chars: int | None = None) -> DataFrame:
    return _cut(_parse_bytes(table, content, filename), max_chars)


def chunk(docs: DataFrame, strategy: str = "auto", chunk_size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP, keywords: bool = False, key: str = "path") -> DataFrame:
    """Chunks of parsed documents; with `keywords`, those of each chunk fitted over its document."""
    out = chunking.chunk(docs.where("text IS NOT NULL"), strategy, chunk_size, overlap, key=key, ext="ext" if "ext" in docs.columns else None)
    if not keywords:
        return out
    words = enrich.tfidf(out, key, "chunk_id")
    return out.join(words, [key, "chunk_id"], "left").withColumn("keywords", F.coalesce("keywords", F.array().cast("array<string>")))


def extract_metadata(docs: DataFrame) -> DataFrame:
    """path, format, title, author, page_count, word_count, char_count and all metadata as JSON."""
    field = lambda name, kind="string": F.get_json_object("metadata", f"$.{name}").cast(kind)
    return docs.select("path", "format", field("title").alias("title"), field("author").alias("author"), F.coalesce(field("page_count", "int"), field("slide_count", "int")).alias("page_count"), T.word_count("text").alias("word_count"), F.length("text").alias("char_count"), "metadata", "error")


def batch(spark: SparkSession, paths: list[str], fail_fast: bool = False) -> DataFrame:
    """ordinal, path, success, text_preview, totals and error of at most 500 files, in the order given."""
    if not paths or len(paths) > MOST_FILES:
        raise ValueError(f"between 1 and {MOST_FILES} files, got {len(paths)}")
    order = spark.createDataFrame([(i, p, p.replace("file:", "").lstrip("/")) for i, p in enumerate(paths)], "ordinal int, asked string, tail string")
    got = _existing(spark, paths)
    found = got.withColumn("tail", F.regexp_replace(F.regexp_replace("path", "^file:", ""), "^/+", ""))
    out = order.join(found, "tail", "left")
    error = F.coalesce("error", F.when(F.col("path").isNull(), F.lit("file not found")))
    if fail_fast:
        error = F.when(error.isNotNull(), F.raise_error(error).cast("string"))
    return out.select("ordinal", F.col("asked").alias("path"), error.isNull().alias("success"), T.preview("text", 500).alias("text_preview"), F.length("text").alias("total_characters"), T.word_count("text").alias("total_words"), error.alias("error")).orderBy("ordinal")


def _existing(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents of those paths that exist; at most MOST_FILES are asked for, in any file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def there(path: str) -> bool:
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf).exists(p)

    found = [p for p in paths if there(p)]
    files = spark.read.format("binaryFile").load(found) if found else spark.createDataFrame([], "path string, content binary")
    return parse_files(files.select("path", "content"))


list_formats = formats.list_formats
is_supported = formats.is_supported


def get_format(path: str) -> str | None:
    """The name of a path's format, or None if it can't be read."""
    ext = formats.suffix(path)
    return formats.FORMATS[ext][0] if formats.reason(ext) is None else None


class Pipeline:
    """documents -> chunks -> enriched chunks -> rendered rows."""

    RENDERERS = {"compact": render.compact_documents, "json": render.json_documents, "markdown": render.markdown_documents, "xml": render.xml_chunks, "nodes": render.graph_nodes, "edges": render.graph_edges, "vectors": render.vector_objects, "csv": render.csv_rows}
    #: Formats that go unenriched.
    BARE = ("code", "xlsx", "csv", "html")

    def __init__(self, strategy: str = "auto", chunk_size: int = chunking.CHUNK_SIZE, overlap: int = chunking.OVERLAP, output: str = "compact"):
        if output not in self.RENDERERS:
            raise ValueError(f"Unknown output: {output!r}. Use one of: {', '.join(self.RENDERERS)}.")
        self.strategy, self.chunk_size, self.overlap, self.output = strategy, chunk_size, overlap, output

    def chunks(self, docs: DataFrame) -> DataFrame:
        """Enriched chunks of documents (doc_id, text, and format and ext if known)."""
        c = chunking.chunk(docs, self.strategy, self.chunk_size, self.overlap, ext="ext" if "ext" in docs.columns else None)
        if "format" not in docs.columns:
            return enrich.enrich(c.drop("section_name"))
        kinds = c.join(docs.select("doc_id", "format"), "doc_id")
        bare = F.col("format").isin(*self.BARE)
        rest = kinds.where(bare).drop("format").withColumn("keywords", F.array().cast("array<string>"))
        return enrich.enrich(kinds.where(~bare).drop("format", "section_name")).unionByName(rest, allowMissingColumns=True)

    def transform(self, docs: DataFrame) -> DataFrame:
        return self.RENDERERS[self.output](self.chunks(docs))


#: Prompt templates by name, with the place of the document's text.
PROMPTS = {
    "summarize": "Summarise the following document in a few paragraphs.\n\n{document}",
    "extract_key_points": "List the key points of the following document.\n\n{document}",
    "answer_question": "Answer this question from the document below: {question}\n\n{document}",
    "compare": "Compare the following document with this one: {other}\n\n{document}",
    "extract_data": "Extract the following fields from the document: {fields}\n\n{document}",
}
PROMPT_CHARS = 50_000


def render_prompt(docs: DataFrame, name: str, **arguments: str) -> DataFrame:
    """docs with `prompt`: the template with its arguments and the text, of which 50 000 characters are used."""
    if name not in PROMPTS:
        raise ValueError(f"Unknown prompt: {name!r}. Use one of: {', '.join(PROMPTS)}.")
    before, _, after = PROMPTS[name].partition("{document}")
    fill = lambda s: s.format(**{k: v for k, v in arguments.items()}) if "{" in s else s
    return docs.withColumn("prompt", F.concat(F.lit(fill(before)), F.substring("text", 1, PROMPT_CHARS), F.lit(fill(after))))
