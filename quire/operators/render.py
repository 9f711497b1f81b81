"""Renderers: enriched chunks as compact lines, JSON, Markdown, XML, graph nodes and edges, vector objects.

All are expressions and one aggregation by document; nothing is collected. Chunk tables have doc_id, chunk_id, text,
start_char, end_char, section_name, section_type, keywords; `with_defaults` adds those that are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T

DEFAULTS = {
    "start_char": lambda: F.lit(0),
    "end_char": lambda: F.length("text"),
    "section_name": lambda: F.lit(None).cast("string"),
    "section_type": lambda: F.lit("text"),
    "keywords": lambda: F.array().cast("array<string>"),
    "heading_level": lambda: F.lit(0),
}


def with_defaults(chunks: DataFrame) -> DataFrame:
    for name, make in DEFAULTS.items():
        if name not in chunks.columns:
            chunks = chunks.withColumn(name, make())
    return chunks


def compact_chunk(preview: int | None = None) -> Column:
    """A chunk's lines: id|start-end|type|name, the text, k:keywords (ten at most)."""
    head = F.concat_ws("|", F.col("chunk_id").cast("string"), F.concat_ws("-", F.col("start_char").cast("string"), F.col("end_char").cast("string")), F.coalesce("section_type", F.lit("text")), T.escape_field("section_name"))
    body = T.preview("text", preview) if preview else F.col("text")
    words = F.when(F.size("keywords") > 0, F.concat(F.lit("k:"), F.array_join(F.slice("keywords", 1, 10), ",")))
    return F.concat_ws("\n", head, body, words)


def compact_documents(chunks: DataFrame, docs: DataFrame | None = None, preview: int | None = None) -> DataFrame:
    """doc_id, rendered: header line, metadata line (if docs has a metadata map), then the chunks, each after ---."""
    c = with_defaults(chunks)
    body = c.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_id", compact_chunk(preview).alias("block")))).alias("blocks"), F.count(F.lit(1)).alias("n"), F.sum(T.word_count("text")).alias("w")
    )
    meta, kind, source = F.lit(None).cast("map<string,string>"), F.lit("unknown"), F.lit(None).cast("string")
    if docs is not None:
        body = body.join(docs, "doc_id")
        meta = F.col("metadata") if "metadata" in docs.columns else meta
        kind = F.col("doc_type") if "doc_type" in docs.columns else kind
        source = F.col("source") if "source" in docs.columns else source
    name = F.when(source.isNotNull() & (source != ""), F.concat(F.lit("s:"), T.escape_field(T.file_name(source))))
    pages = F.when(meta["page_count"].isNotNull(), F.concat(F.lit("p:"), meta["page_count"]))
    head = F.concat_ws("|", F.concat(F.lit("d:"), T.escape_field(F.col("doc_id").cast("string"))), F.concat(F.lit("t:"), kind), name, F.concat(F.lit("w:"), F.col("w").cast("string")), F.concat(F.lit("n:"), F.col("n").cast("string")), pages)
    pairs = [F.when(meta[k].isNotNull() & (meta[k] != ""), F.concat(F.lit(f"{k}="), T.escape_value(meta[k]))) for k in ("author", "title", "created", "modified", "subject")]
    line = F.concat_ws(",", *pairs)
    chunk_lines = F.array_join(F.transform("blocks", lambda b: F.concat(F.lit("---\n"), b["block"])), "\n")
    return body.select("doc_id", F.concat_ws("\n", head, F.when(line != "", F.concat(F.lit("m:"), line)), chunk_lines).alias("rendered"))


def compact_raw(path: Column, text: Column, doc_type: Column, metadata: Column, pages: Column | None = None, images: Column | None = None, continuation: Column | None = None, total_chars: Column | None = None) -> Column:
    """A whole document: header, author/title/subject, a hint where it is cut, and the content."""
    total = F.length(text) if total_chars is None else total_chars
    part = lambda mark, c: F.when(c.isNotNull() & (c != 0), F.concat(F.lit(mark), c.cast("string"))) if c is not None else F.lit(None).cast("string")
    head = F.concat_ws("|", F.concat(F.lit("d:"), T.file_name(path)), F.concat(F.lit("t:"), doc_type), F.concat(F.lit("w:"), T.word_count(text).cast("string")), F.concat(F.lit("c:"), total.cast("string")), part("p:", pages), part("i:", images))
    value = lambda v: F.replace(F.replace(v, F.lit(","), F.lit("\\,")), F.lit("="), F.lit("\\="))
    pairs = F.concat_ws(",", *[F.when(metadata[k].isNotNull() & (metadata[k] != ""), F.concat(F.lit(f"{k}="), value(metadata[k]))) for k in ("author", "title", "subject")])
    hint = F.lit(None).cast("string") if continuation is None else F.when(continuation.isNotNull(), F.concat(F.lit("~+"), (total - continuation).cast("string"), F.lit("chars|use:get_document_chunk(offset="), continuation.cast("string"), F.lit(")")))
    return F.concat_ws("\n", head, F.when(pairs != "", F.concat(F.lit("m:"), pairs)), hint, F.lit("---"), F.lit("content"), text)


def compact_metadata(path: Column, doc_type: Column, total_chars: Column, metadata: Column, pages: Column | None = None) -> Column:
    """Header and at most 15 fields of at most 100 characters each."""
    head = F.concat_ws("|", F.concat(F.lit("d:"), T.file_name(path)), F.concat(F.lit("t:"), doc_type), F.concat(F.lit("c:"), total_chars.cast("string")), F.when(pages.isNotNull(), F.concat(F.lit("p:"), pages.cast("string"))) if pages is not None else F.lit(None).cast("string"))
    entries = F.transform(F.filter(F.map_entries(metadata), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.struct(e["key"].alias("k"), T.escape_value(e["value"]).alias("v")))
    fields = F.slice(F.transform(F.filter(entries, lambda e: F.length(e["v"]) <= 100), lambda e: F.concat_ws("=", e["k"], e["v"])), 1, 15)
    return F.concat_ws("\n", head, F.when(F.size(fields) > 0, F.concat(F.lit("m:"), F.array_join(fields, ","))))


def compact_page(path: Column, text: Column, offset: Column, limit: Column, total: Column) -> Column:
    after = offset + F.length(text)
    head = F.concat(F.lit("d:"), T.file_name(path), F.lit("|offset:"), offset.cast("string"), F.lit("|limit:"), limit.cast("string"), F.lit("|total:"), total.cast("string"))
    more = F.when(total > after, F.concat(F.lit("~+"), (total - after).cast("string"), F.lit("chars|next:get_document_chunk(offset="), after.cast("string"), F.lit(")")))
    return F.concat_ws("\n", head, more, F.lit("---"), text)


def json_documents(chunks: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """doc_id, json: the document with its chunk list in order."""
    c = with_defaults(chunks)
    fields = ["chunk_id", "text", "start_char", "end_char", "keywords", "section_name", "section_type", *[x for x in ("computed",) if x in c.columns]]
    out = c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("chunks"), F.count(F.lit(1)).alias("total_chunks"), F.sum(T.word_count("text")).alias("total_words"))
    if docs is not None:
        out = out.join(docs, "doc_id")
    extra = [x for x in ("source", "doc_type", "metadata") if docs is not None and x in docs.columns]
    return out.select("doc_id", F.to_json(F.struct(F.col("doc_id").alias("document_id"), *extra, "total_chunks", "total_words", "chunks")).alias("json"))


def graph_nodes(chunks: DataFrame) -> DataFrame:
    """node_id, label, name, doc_id, n: documents, chunks (with a preview) and sections (with their number of chunks)."""
    c = with_defaults(chunks)
    doc = F.col("doc_id").cast("string")
    documents = c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).select(doc.alias("node_id"), F.lit("Document").alias("label"), F.lit("Untitled").alias("name"), "doc_id", "n")
    pieces = c.select(chunk_node().alias("node_id"), F.lit("Chunk").alias("label"), T.preview("text", 200).alias("name"), "doc_id", T.word_count("text").alias("n"))
    name = F.coalesce(F.when(F.col("section_name") != "", F.col("section_name")), F.lit("Untitled Section"))
    sections = c.groupBy("doc_id", name.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.concat(doc, F.lit("_section_"), T.slug("name")).alias("node_id"), F.lit("Section").alias("label"), "name", "doc_id", "n")
    return documents.unionByName(pieces).unionByName(sections)


def chunk_node() -> Column:
    return F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_id").cast("string"))


def graph_edges(chunks: DataFrame) -> DataFrame:
    """kind, from_node, to_node: PART_OF of every chunk; HAS_SECTION and CONTAINS of every chunk with a section."""
    c = with_defaults(chunks)
    doc = F.col("doc_id").cast("string")
    section = F.concat(doc, F.lit("_section_"), T.slug("section_name"))
    edge = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("from_node"), b.alias("to_node"))
    named = F.col("section_name").isNotNull() & (F.col("section_name") != "")
    all_edges = F.concat(F.array(edge("PART_OF", chunk_node(), doc)), F.when(named, F.array(edge("HAS_SECTION", doc, section), edge("CONTAINS", section, chunk_node()))).otherwise(F.array().cast("array<struct<kind:string,from_node:string,to_node:string>>")))
    return c.select(F.inline(all_edges))


def vector_objects(chunks: DataFrame, collection: str = "Document", vector: str | None = None) -> DataFrame:
    """class, id, properties (and vector): one object for each chunk."""
    c = with_defaults(chunks)
    properties = F.struct(
        F.col("text").alias("content"), F.col("doc_id").cast("string").alias("docId"), F.col("chunk_id").alias("chunkIndex"), "keywords", F.col("section_name").alias("sectionName"),
        F.col("section_type").alias("sectionType"), T.word_count("text").alias("wordCount"), T.reading_time("text").alias("readingTime"),
    )
    return c.select(F.lit(collection).alias("class"), chunk_node().alias("id"), properties.alias("properties"), *([F.col(vector).alias("vector")] if vector else []))


def markdown_documents(chunks: DataFrame) -> DataFrame:
    """doc_id, markdown: a heading for each chunk, its section, and its text."""
    c = with_defaults(chunks)
    block = F.concat_ws("\n\n", F.concat(F.lit("## Chunk "), F.col("chunk_id").cast("string")), F.when(F.col("section_name").isNotNull(), F.concat(F.lit("**Section:** "), F.col("section_name"))), F.col("text"))
    return c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", block.alias("b")))).alias("bs")).select("doc_id", F.array_join(F.transform("bs", lambda b: b["b"]), "\n\n").alias("markdown"))


def xml_tag(name: str | Column) -> Column:
    """A name that XML allows: a letter or _ first, then letters, digits, -, _ or a point."""
    n = F.regexp_replace(F.col(name) if isinstance(name, str) else name, r"[^\p{L}\p{N}_.-]", "_")
    return F.when(n == "", F.lit("_")).when(n.rlike(r"^[\p{L}_]"), n).otherwise(F.concat(F.lit("_"), n))


def xml_text(text: str | Column) -> Column:
    t = F.regexp_replace(F.col(text) if isinstance(text, str) else text, "[\u0000-\u0008\u000b\u000c\u000e-\u001f]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        t = F.replace(t, F.lit(mark), F.lit(name))
    return t


def xml_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, xml: <chunks> with one <chunk id> each."""
    c = with_defaults(chunks)
    block = F.concat(F.lit('  <chunk id="'), F.col("chunk_id").cast("string"), F.lit('">\n    <text>'), xml_text("text"), F.lit("</text>\n  </chunk>"))
    return c.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_id", block.alias("b")))).alias("bs")).select("doc_id", F.concat(F.lit("<chunks>\n"), F.array_join(F.transform("bs", lambda b: b["b"]), "\n"), F.lit("\n</chunks>")).alias("xml"))


def csv_rows(chunks: DataFrame) -> DataFrame:
    """The flat columns that a CSV writer takes."""
    c = with_defaults(chunks)
    return c.select("doc_id", "chunk_id", T.word_count("text").alias("word_count"), "section_name", F.array_join("keywords", "; ").alias("keywords"), "text")


def valid(chunks: DataFrame) -> DataFrame:
    """Chunks that a renderer accepts: a document id that isn't empty. Documents without chunks have no rows."""
    return chunks.where(F.coalesce(F.col("doc_id").cast("string"), F.lit("")) != "")
