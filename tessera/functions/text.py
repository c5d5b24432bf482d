"""Text functions: tokens, identifiers, blank tests, URLs, paths, Markdown normalization."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKEN = r"[A-Za-z0-9_]+|[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"


def tokenize(text: Column) -> Column:
    """Runs of ASCII word characters and single CJK characters, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


_TOKEN_UTF8 = re.compile(rb"[a-z0-9_]+|\xe3[\x90-\xbf][\x80-\xbf]|\xe4[\x80-\xb6\xb8-\xbf][\x80-\xbf]|[\xe5-\xe9][\x80-\xbf][\x80-\xbf]")


def utf8_tokens(text: bytes | None) -> list[bytes]:
    """What `tokenize` finds, for UTF-8 in Python workers; lower() of bytes changes ASCII only."""
    return _TOKEN_UTF8.findall(text.lower()) if text else []


#: Bytes of text of which a Python worker makes objects at a time; a longer text is one slice of its own.
SLICE_BYTES = 1_000_000


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows with at most `most` bytes of text each, at least one row."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def chunk_id(source_id: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws(":", source_id, index.cast("string")), 256)


def is_blank(text: Column) -> Column:
    """Null, empty or white space only, with the separators U+001C to U+001F counting as white space."""
    return text.isNull() | text.rlike(r"^[\p{IsWhite_Space}\x1C-\x1F]*$")


def extension(name: Column) -> Column:
    """Suffix in lower case without the dot; empty where there is none."""
    return F.lower(F.regexp_extract(name, r"[^/\\]\.([^./\\]+)$", 1))


def normalize_extension(ext: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(ext), r"^\.+", ""))


def safe_name(name: Column) -> Column:
    """Whether a file name stays inside its folder."""
    return ~(F.coalesce(name, F.lit("")).isin("", ".", "..") | name.rlike(r"[/\\\x00]"))


def mime_type(name: Column) -> Column:
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp", "svg": "image/svg+xml", "pdf": "application/pdf"}
    out = F.lit("application/octet-stream")
    for ext, mime in kinds.items():
        out = F.when(extension(name) == ext, mime).otherwise(out)
    return out


def data_url(mime: Column, content: Column) -> Column:
    """Base64 in one line: Spark may break it into lines of 76."""
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def from_data_url(url: Column) -> Column:
    return F.unbase64(F.split_part(url, F.lit(","), F.lit(2)))


def clean_source(text: Column) -> Column:
    """The part of Markdown normalization that needs no state: line ends, byte order marks, NULs."""
    return F.translate(F.regexp_replace(text, "\r\n?", "\n"), "﻿\x00", "")


_FENCED = re.compile(r" {0,3}(`{3,}|~{3,})(.*)$")


def normalize_text(text: str | None) -> str | None:
    """Markdown in normal form: NFC, \\n line ends, no trailing blanks, single blank lines; fenced code as it is."""
    if text is None:
        return None
    for old, new in (("\r\n", "\n"), ("\r", "\n"), ("﻿", ""), ("\x00", "")):
        text = text.replace(old, new)
    kept: list[str] = []
    opened = ""
    for raw in unicodedata.normalize("NFC", text).split("\n"):
        found = _FENCED.match(raw)
        fence, info = found.groups() if found else ("", "")
        if opened:
            kept.append(raw)
            if fence[:1] == opened[0] and len(fence) >= len(opened) and not info.strip():
                opened = ""
        elif fence:
            kept.append(raw.replace(" ", " ").rstrip(" \t"))
            opened = fence
        else:
            line = raw.replace(" ", " ").rstrip(" \t")
            if line or (kept and kept[-1]):
                kept.append(line)
    while kept and not kept[-1]:
        del kept[-1]
    return "\n".join(kept)


@F.arrow_udf(StringType())
def normalize_markdown(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for a, b in slices(texts):
            yield pa.array(map(normalize_text, texts.slice(a, b - a).to_pylist()), pa.string())


def table_markdown(rows: Column) -> Column:
    """array<array<string>> as a Markdown table with the first row as header."""
    cell = lambda c: F.regexp_replace(F.replace(c, F.lit("|"), F.lit("\\|")), "\n", "<br>")
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda _: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")
