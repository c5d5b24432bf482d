"""File scans: local or object storage by binaryFile, content types, extraction by registered hooks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions.text import extension, normalize_text
from tessera.sources import docx, formats

MAX_BYTES = 100 << 20
Extractor = Callable[[bytes], str]


def detect(head: bytes, name: str = "") -> str | None:
    """Type by magic bytes; plain text where everything decodes; None: unknown."""
    if head.startswith(b"%PDF-"):
        return "pdf"
    if head.startswith(b"PK\x03\x04"):
        try:
            parts = zipfile.ZipFile(io.BytesIO(head)).namelist()
        except zipfile.BadZipFile:
            return None
        return next((t for p, t in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")) if any(x.startswith(p) for x in parts)), None)
    if head.startswith(b"\xd0\xcf\x11\xe0"):
        return "doc"
    try:
        text = head.decode("utf-8").lstrip("﻿ \t\r\n").lower()
    except UnicodeDecodeError:
        return None
    if "\x00" in text:
        return None
    return "html" if text.startswith(("<!doctype html", "<html")) else "xml" if text.startswith("<?xml") else "txt"


@F.pandas_udf(StringType())
def detected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for contents in batches:
        yield contents.map(detect, na_action="ignore")


class Registry:
    """Extractors by file type, whatever its case; the last registration wins."""

    def __init__(self, hooks: dict[str, Extractor] | None = None):
        self._hooks = dict(hooks or {})

    def register(self, file_type: str, hook: Extractor) -> None:
        self._hooks[file_type.lower().lstrip(".")] = hook

    def get(self, file_type: str) -> Extractor:
        try:
            return self._hooks[file_type.lower().lstrip(".")]
        except KeyError:
            raise ValueError(f"no extractor for {file_type!r}") from None

    def fork(self) -> "Registry":
        return Registry(self._hooks)

    snapshot = fork

    def restore(self, saved: "Registry") -> None:
        self._hooks = dict(saved._hooks)

    @contextmanager
    def temporary(self):
        saved = self.snapshot()
        try:
            yield self
        finally:
            self.restore(saved)


def default_registry() -> Registry:
    """Word documents, and all text-like formats as they are."""
    out = Registry()
    for t in ("docx", "doc"):
        out.register(t, lambda content: docx.markdown(docx.blocks(content)))
    for t in (*formats.TEXT_LIKE, "csv", "json", "yaml", "xml"):
        out.register(t, lambda content: content.decode("utf-8", "replace"))
    return out


def scan(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES, stream: bool = False) -> DataFrame:
    """source, source_id, declared, length, content of non-empty files up to the cap; the length filter is pushed to the
    file listing. Any path that Hadoop reads (file, s3a, hdfs)."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    files = reader.format("binaryFile").load(path)
    kept = files.where((F.col("length") > 0) & (F.col("length") <= min(max_bytes, MAX_BYTES)))
    return kept.select(F.col("path").alias("source"), formats.source_id(F.col("path")).alias("source_id"), extension(F.col("path")).alias("declared"), "length", "content")


def file_type(declared: Column, content: Column) -> Column:
    return formats.resolved_type(declared, detected(content))


def extract(files: DataFrame, registry: Registry | None = None) -> DataFrame:
    """source_id, source, file_type, markdown, error: each file through its extractor and the normalizer."""
    hooks = registry or default_registry()
    typed = files.withColumn("file_type", file_type(F.col("declared"), F.col("content")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples():
                text = error = None
                try:
                    if row.file_type is None:
                        raise ValueError(f"content is not {row.declared}")
                    text = normalize_text(hooks.get(row.file_type)(row.content))
                except Exception as e:  # noqa: BLE001 - one bad file is a row with an error, not a failed job
                    error = f"{type(e).__name__}: {e}"
                out.append((row.source_id, row.source, row.file_type, text, error))
            yield pd.DataFrame(out, columns=["source_id", "source", "file_type", "markdown", "error"])

    return typed.mapInPandas(run, "source_id string, source string, file_type string, markdown string, error string")
