"""Vector functions."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors of equal length; 0 where one is zero; an error for different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length"))).otherwise(value)


def decode_vector(text: str) -> list[float]:
    raw = base64.b64decode(text, validate=True)
    if len(raw) % 4:
        raise ValueError("not a whole number of 32-bit floats")
    return np.frombuffer(raw, "<f4").astype(float).tolist()


@F.pandas_udf(ArrayType(DoubleType()))
def decode_vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Base64 of little-endian 32-bit floats."""
    for texts in batches:
        yield texts.map(decode_vector, na_action="ignore")
