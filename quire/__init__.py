"""Spark-native document analytics: files and text tables to documents, chunks, enriched chunks and sinks."""

__version__ = "0.1.0"
