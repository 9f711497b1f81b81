"""The formats: what each extension is, which reader takes it, and whether it can be read here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T

CODE = (".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".cpp", ".c", ".go", ".rs")
#: extension: (reader, description)
FORMATS = {
    ".c": ("code", "C source code"), ".cpp": ("code", "C++ source code"), ".csv": ("csv", "Comma-separated values"), ".doc": ("docx", "Word documents in Office Open XML format under a .doc name"),
    ".docx": ("docx", "Word documents"), ".eml": ("eml", "Email messages"), ".epub": ("epub", "E-books"), ".go": ("code", "Go source code"), ".htm": ("html", "Web pages"), ".html": ("html", "Web pages"),
    ".java": ("code", "Java source code"), ".js": ("code", "JavaScript source code"), ".json": ("json", "JSON data"), ".jsx": ("code", "React source code"), ".log": ("text", "Log files"),
    ".markdown": ("markdown", "Markdown documents"), ".md": ("markdown", "Markdown documents"), ".msg": ("msg", "Outlook messages"), ".pdf": ("pdf", "PDF documents"), ".ppt": ("ppt", "Binary presentations"),
    ".pptx": ("pptx", "Presentations"), ".py": ("code", "Python source code"), ".rs": ("code", "Rust source code"), ".rtf": ("rtf", "Rich text"), ".text": ("text", "Plain text"), ".ts": ("code", "TypeScript source code"),
    ".tsv": ("csv", "Tab-separated values"), ".tsx": ("code", "React TypeScript source code"), ".txt": ("text", "Plain text"), ".xlsm": ("xlsx", "Workbooks with macros"), ".xlsx": ("xlsx", "Workbooks"),
    ".xltm": ("xlsx", "Workbook templates with macros"), ".xltx": ("xlsx", "Workbook templates"), ".xml": ("xml", "XML documents"), ".yaml": ("yaml", "YAML data"), ".yml": ("yaml", "YAML data"),
}
UNAVAILABLE = {
    "pdf": "no PDF parser is installed; give its lines or pages as a table instead",
    "msg": "no parser for Outlook messages is installed",
    "ppt": "binary PowerPoint files can't be read; save the deck as .pptx first",
}


def reason(ext: str) -> str | None:
    """Why an extension can't be read, or None."""
    if ext not in FORMATS:
        return f"Unsupported file format: {ext or '(no extension)'}. Supported formats: {', '.join(sorted(FORMATS))}"
    return UNAVAILABLE.get(FORMATS[ext][0])


def is_supported(path: str) -> bool:
    return reason(suffix(path)) is None


def suffix(path: str) -> str:
    name = path.replace("\\", "/").rpartition("/")[2]
    dot = name.rfind(".")
    return name[dot:].lower() if dot > 0 else ""


def list_formats(spark: SparkSession) -> DataFrame:
    """extension, reader, description, available, reason: one row for each known extension."""
    rows = [(e, r, d, reason(e) is None, reason(e)) for e, (r, d) in sorted(FORMATS.items())]
    return spark.createDataFrame(rows, "extension string, reader string, description string, available boolean, reason string")


def with_format(files: DataFrame, path: str = "path") -> DataFrame:
    """files with ext, reader and available; the table of formats has a fixed size, so it is broadcast."""
    f = list_formats(files.sparkSession).select(F.col("extension").alias("ext"), "reader", "available", "reason")
    return files.withColumn("ext", T.extension(path)).join(F.broadcast(f), "ext", "left")
