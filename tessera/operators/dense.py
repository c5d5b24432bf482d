"""Dense search: exact cosine of a set of queries against all rows, in blocks."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one block; they are broadcast, and a larger set is answered block by block.
BLOCK = 4096
#: Pairs that `cosines` has in memory at a time, and tasks a core that share its rows.
PAIRS, SHARES = 250_000, 4


def blocks(queries: DataFrame, most: int = BLOCK) -> Iterator[list]:
    """The rows of a set of queries, so many at a time."""
    block: list = []
    for row in queries.toLocalIterator():
        block.append(row)
        if len(block) == most:
            yield block
            block = []
    if block:
        yield block


def _scan(ids, matrix, k):
    """Best k rows of each partition for each query; rows of (id, embedding)."""
    norms = np.linalg.norm(matrix, axis=1)
    unit = matrix / np.where(norms == 0, 1, norms)[:, None]

    def run(batches):
        held_q, held_i, held_s = (np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0))
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array(batch.column(0).to_pylist(), object)
            x = np.asarray(batch.column(1).flatten(), dtype=np.float64).reshape(len(own), -1)
            if x.shape[1] != unit.shape[1]:
                raise ValueError("vectors differ in length")
            n = np.linalg.norm(x, axis=1)
            x = x / np.where(n == 0, 1, n)[:, None]
            for a in range(0, len(unit), 256):
                s = unit[a : a + 256] @ x.T
                cut = np.partition(s, -min(k, s.shape[1]), axis=1)[:, -min(k, s.shape[1])]
                i, j = np.nonzero(s >= cut[:, None] - 1e-9)
                held_q, held_i, held_s = np.append(held_q, i + a), np.append(held_i, own[j]), np.append(held_s, s[i, j])
            if len(held_q) > 20 * k * len(unit) + 100_000:
                held_q, held_i, held_s = _trim(held_q, held_i, held_s, k)
        held_q, held_i, held_s = _trim(held_q, held_i, held_s, k)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[held_q]), pa.array(held_i.tolist(), pa.string()), pa.array(held_s)], ["query_id", "id", "score"])

    return run


def _trim(q, i, s, k):
    """The best k and all within rounding of the k-th, by query."""
    order = np.lexsort((-s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.searchsorted(q, q)
    kth = s[np.minimum(first + k - 1, np.searchsorted(q, q, side="right") - 1)]
    keep = s >= kth - 1e-9
    return q[keep], i[keep], s[keep]


def ranked(hits: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The best k of each query by (score, id) as rank 1..k; scores rounded, so that summation order decides no tie."""
    hits = hits.withColumn("score", F.round("score", digits))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def dense_topk(rows: DataFrame, queries: DataFrame, k: int, where: Column | None = None) -> DataFrame:
    """query_id, id, score, rank: the k rows (id, embedding) of largest cosine for each query (query_id, vector).
    The filter is applied before scoring. A zero vector scores 0."""
    if k <= 0:
        raise ValueError("top_k must be positive")
    rows = (rows if where is None else rows.where(where)).select(F.col("id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    out = None
    for block in blocks(asked):
        part = rows.mapInArrow(_scan([r[0] for r in block], np.array([r[1] for r in block], float), k), "query_id long, id string, score double")
        out = part if out is None else out.union(part)
    if out is None:
        out = rows.sparkSession.createDataFrame([], "query_id long, id string, score double")
    return ranked(out, k)


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero, as SQL does; never -0.0."""
    t = np.abs(x) * 10.0**digits
    whole = np.floor(t)
    return np.copysign((whole + (t - whole >= 0.5)) / 10.0**digits, x) + 0.0


def _lengths(column: pa.Array) -> np.ndarray:
    """Of arrays; -1 for a null."""
    return np.asarray(pc.fill_null(pc.list_value_length(column), -1), np.int64)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(matrix, norms, known) of arrays of doubles; a null, or one that holds a null, isn't known."""
    length = np.maximum(_lengths(column), 0)
    row = np.repeat(np.arange(len(length)), length)
    at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    values = column.flatten()
    matrix, known = np.zeros((len(length), width)), np.array(column.is_valid())
    known[row[np.asarray(values.is_null())]] = False
    matrix[row[at < width], at[at < width]] = np.asarray(values.fill_null(0.0), np.float64)[at < width]
    return matrix, np.sqrt(np.einsum("ij,ij->i", matrix, matrix)), known


def _pairs(ids, vectors, digits):
    """Every row of (id, embedding) with each query, PAIRS of them at a time."""
    ids, vectors = pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.float64()))
    lengths = {*_lengths(vectors).tolist()} - {-1}
    asked, asked_norms, asked_known = _matrix(vectors, max(1, *lengths, 1))

    def run(batches):
        for batch in batches:
            own = {*_lengths(batch.column(1)).tolist()} - {-1}
            if own and lengths and len(own | lengths) > 1:
                raise ValueError("vectors differ in length")
            x, norms, known = _matrix(batch.column(1), asked.shape[1])
            for a in range(0, len(x), 1000):
                n = len(x[a : a + 1000])
                for b in range(0, len(ids), max(1, PAIRS // n)):
                    q, r = slice(b, b + max(1, PAIRS // n)), slice(a, a + n)
                    both = np.outer(asked_norms[q], norms[r])
                    with np.errstate(all="ignore"):
                        score = _rounded(np.where(both == 0, 0.0, asked[q] @ x[r].T / both), digits).ravel()
                    i, j = np.divmod(np.arange(len(score)), n)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(i + b)), batch.column(0).take(pa.array(j + a)), pa.array(score, mask=~np.outer(asked_known[q], known[r]).ravel())], ["query_id", "id", "score"])

    return run


def cosines(rows: DataFrame, queries: DataFrame, digits: int = 9) -> DataFrame:
    """query_id, id, score: the cosine of every row (id, embedding) with each query (query_id, vector), rounded. All pairs are
    the result, so time grows with rows times queries; a task holds PAIRS of them. A zero vector scores 0, a null one null."""
    rows = rows.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"))
    # Few bytes of vectors make many rows: they are spread over the cores, however few files they come from.
    rows = rows.repartition(SHARES * rows.sparkSession.sparkContext.defaultParallelism)
    parts = [rows.mapInArrow(_pairs([r[0] for r in block], [r[1] for r in block], digits), "query_id long, id long, score double") for block in blocks(asked)]
    return functools.reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], "query_id long, id long, score double")
