"""Cross-polytope hashing: pseudo-random rotations by fast Hadamard transforms, nearest signed axis, probe orders; and
the streaming of hash groups through blocks of bounded size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hadamard(x: np.ndarray) -> np.ndarray:
    """Rows of x (n, power of two) times the Hadamard matrix, normalised."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """x padded with zeros to a power of two and rotated by three rounds of random signs and a Hadamard transform."""
    d = 1 << max(0, x.shape[1] - 1).bit_length()
    y = np.zeros((len(x), d))
    y[:, : x.shape[1]] = x
    signs = np.random.default_rng(seed).integers(0, 2, (3, d)) * 2.0 - 1
    for s in signs:
        y = hadamard(y * s)
    return y


def axes(y: np.ndarray, probes: int = 1) -> np.ndarray:
    """(n, probes): codes of the nearest signed axes, nearest first: 2 * axis + (1 if negative)."""
    both = np.stack((y, -y), axis=2).reshape(len(y), -1)
    if probes == 1:
        return both.argmax(1)[:, None]
    probes = min(probes, both.shape[1])
    top = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    order = np.take_along_axis(both, top, 1).argsort(1)[:, ::-1]
    return np.take_along_axis(top, order, 1)


def valid(c: Column) -> Column:
    """Whether a vector takes part: not null, of finite components that aren't null, not zero."""
    ok = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(c.isNotNull() & ok & F.exists(c, lambda x: x != 0), F.lit(False))


def prepared(vectors: DataFrame, *keep: str) -> DataFrame:
    """vec_id, *keep and v array<double> of the rows that take part."""
    return vectors.where("vec_id is not null").select("vec_id", *keep, F.col("embedding").cast("array<double>").alias("v")).where(valid(F.col("v")))


def by_length(batch: pa.RecordBatch, column: int):
    """The rows of a batch with vectors of one length each."""
    n = np.asarray(pc.list_value_length(batch.column(column)))
    for d in np.unique(n):
        yield batch if (n == d).all() else batch.take(pa.array(np.flatnonzero(n == d)))


def matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def grouped(batches, key: str):
    """Runs of equal keys in batches sorted by key, one RecordBatch a run; a run is as large as the blocks allow."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.asarray(batch.column(batch.schema.get_field_index(key)))
        cuts = np.flatnonzero(k[1:] != k[:-1]) + 1
        edges = [0, *cuts.tolist(), len(k)]
        for a, b in zip(edges, edges[1:]):
            part = batch.slice(a, b - a)
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != int(k[a]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
