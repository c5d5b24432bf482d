"""Shared pieces of the training-data operators: shared-folder tables, Arrow slices of texts, word hashes."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a Python worker turns into numpy arrays at a time; a longer text is one slice of its own.
SLICE_BYTES = 2_000_000
M64 = (1 << 64) - 1
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at a time where they hold texts: a batch is in memory in the JVM and in the worker.
BATCH, TEXT_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only where the session names none (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file:///tmp/tessera-shared"
    return folder


@contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def few_texts(spark: SparkSession):
    """While it lasts, jobs send at most TEXT_ROWS rows at a time to a Python worker."""
    return _setting(spark, BATCH, str(TEXT_ROWS))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors. The shuffle files
    of the write are deleted at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    spark = tables[0].sparkSession
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Ranges [a, b) of rows with at most `most` bytes each, at least one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 over uint64."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INV)):
            p = np.full(n + 1024, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray):
    """The words `[^\\x20\\x09-\\x0D]+` of rows laid end to end.

    Returns (start, end, row, hash): byte offsets from offsets[0], row number, a 64-bit hash of each word's bytes:
    a polynomial over random byte values by prefix sums, finished by a mixer. No word crosses a row's end.
    """
    base = int(offsets[0])
    text = data[base : int(offsets[-1])]
    n = len(text)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    inner = ~_SPACE[text]
    first = np.zeros(n + 1, bool)
    cuts = offsets - base
    first[cuts] = True
    start = np.flatnonzero(inner & np.concatenate(([True], ~inner[:-1] | first[1:n])))
    end = np.flatnonzero(inner & np.concatenate((~inner[1:] | first[1:n], [True]))) + 1
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[text] * power[:n], out=total[1:])
    h = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))
    return start, end, np.searchsorted(cuts, start, side="right") - 1, h


def grams(h: np.ndarray, row: np.ndarray, k: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of every run of k words within one row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rng = pow(_BASE + 2 * seed, 3, 1 << 64) | 1
    total, c = np.zeros(n, np.uint64), 1
    for j in range(k):
        total += h[j : j + n] * np.uint64(c)
        c = c * rng & M64
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    return at, mix(total[at] ^ np.uint64(seed * 0x9E3779B97F4A7C15 & M64))
