"""File formats, source strings and their admission, as tables and Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: structure -> (extensions, default granularity, supported granularities)
FORMATS = {
    "prose": ("txt", "whole", "whole by_page by_chunk"),
    "mixed": ("doc docx pdf md", "by_chunk", "whole by_page by_chunk"),
    "slide": ("ppt pptx", "by_page", "whole by_page by_chunk"),
    "tabular": ("csv xlsx xls", "by_row", "by_row"),
    "structured": ("json yaml xml", "by_node", "whole by_node"),
    "code": ("py ts js java c cpp go php r rs html", "whole", "whole by_chunk"),
}
#: A detector may take these for plain text; the declared suffix then decides.
TEXT_LIKE = ("txt", "md", *FORMATS["code"][0].split())


def format_table(spark: SparkSession) -> DataFrame:
    """extension, structure, default_granularity, granularities: a small dimension table."""
    rows = [(ext, name, default, supported.split()) for name, (exts, default, supported) in FORMATS.items() for ext in exts.split()]
    return spark.createDataFrame(rows, "extension string, structure string, default_granularity string, granularities array<string>")


def unregistered(allowed: Column) -> Column:
    """Allowed extensions that no format has."""
    return F.array_except(allowed, F.array(*[F.lit(e) for exts, _, _ in FORMATS.values() for e in exts.split()]))


def resolved_type(declared: Column, detected: Column) -> Column:
    """The detected type wins; detected plain text may be the declared text-like type; any other difference is null.
    Without a detection the declared type counts, if it is registered."""
    every = [e for exts, _, _ in FORMATS.values() for e in exts.split()]
    return (
        F.when(detected.isNull(), F.when(declared.isin(every), declared))
        .when(F.coalesce(declared, F.lit("")) == "", detected)
        .when(detected == declared, detected)
        .when((detected == "txt") & declared.isin(*TEXT_LIKE), declared)
    )


def source_type(source: Column) -> Column:
    scheme = F.lower(F.regexp_extract(source, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    return F.when(scheme.isin("http", "https"), "url").when(scheme.isin("s3", "minio"), "s3").when(scheme.isin("", "file"), "local").otherwise("unknown")


def source_id(source: Column) -> Column:
    """Hash of the path (local, absolute) or of the string as given."""
    return F.sha2(source, 256)


def s3_parts(source: Column) -> Column:
    """struct(bucket, key) of s3:// and minio:// addresses; null where there are credentials, a port, a query, a fragment or no key."""
    ok = source.rlike(r"^(?i:s3|minio)://[^/@:?#]+/[^?#]+$")
    return F.when(ok, F.struct(F.regexp_extract(source, r"://([^/]+)/", 1).alias("bucket"), F.url_decode(F.regexp_extract(source, r"://[^/]+/(.+)$", 1)).alias("key")))


def routed(source: Column, routes: list[tuple[str, str]]) -> Column:
    """Name of the first route whose pattern matches; null: none. Names are unique."""
    if len({n for n, _ in routes}) < len(routes):
        raise ValueError("route names must be unique")
    out = F.lit(None).cast("string")
    for name, pattern in reversed(routes):
        out = F.when(source.rlike(pattern), name).otherwise(out)
    return out


def admitted(source: Column, hosts: list[str] | None = None, buckets: list[str] | None = None, local_roots: list[str] | None = None) -> Column:
    """Whether policy lets a source in: local files only below the roots and without "..", private and loopback addresses never."""
    host = F.lower(F.parse_url(source, F.lit("HOST")))
    kind = source_type(source)
    private = host.rlike(r"^(localhost|0\.|10\.|127\.|169\.254\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.|\[)") | host.rlike(r"(^|\.)(local|internal)$")
    url = host.isNotNull() & ~private & (F.lit(True) if hosts is None else host.isin(hosts))
    bucket = s3_parts(source)["bucket"]
    s3 = bucket.isNotNull() & (F.lit(True) if buckets is None else bucket.isin(buckets))
    path = F.regexp_replace(source, "^file://", "")
    local = F.lit(False)
    for root in local_roots or []:
        local = local | path.startswith(root.rstrip("/") + "/")
    local = local & ~path.rlike(r"(^|/)\.\.(/|$)")
    return F.coalesce(F.when(kind == "url", url).when(kind == "s3", s3).when(kind == "local", local).otherwise(F.lit(False)), F.lit(False))
