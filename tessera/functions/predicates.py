"""Metadata filters: equality and membership joined by AND, typed and null-safe, as Columns."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _typed(column: Column, value: Any) -> Column:
    """Equality with a plain column; a value of another type matches nothing."""
    return column.isNull() if value is None else F.coalesce(column == F.lit(value), F.lit(False))


def _variant(metadata: Column, key: str, value: Any) -> Column:
    """Equality with a key of VARIANT metadata by JSON type: "1" is not 1; a missing key and a JSON null are None."""
    if any(c in key for c in "\"\\'"):
        item = F.try_element_at(F.try_variant_get(metadata, "$", "map<string,variant>"), F.lit(key))
    else:
        item = F.try_variant_get(metadata, f'$["{key}"]', "variant")
    kind = F.schema_of_variant(item)
    if value is None:
        return item.isNull() | F.coalesce(F.is_variant_null(item), F.lit(False))
    if isinstance(value, bool):
        return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(item, "$", "boolean") == value), F.lit(False))
    if isinstance(value, (int, float)):
        number = reduce(lambda a, b: a | b, [kind.startswith(t) for t in _NUMBER])
        return F.coalesce(number & (F.try_variant_get(item, "$", "double") == float(value)), F.lit(False))
    return F.coalesce((kind == "STRING") & (F.try_variant_get(item, "$", "string") == str(value)), F.lit(False))


def matches(given: Mapping[str, Any] | None, columns: Mapping[str, Column], metadata: Column | None = None) -> Column:
    """Condition of a filter: keys among `columns` are read there (and pushed to the scan), others in `metadata`. An
    empty filter holds for all rows, an empty list for none; a key that exists nowhere reads as None."""
    parts = []
    for key, value in (given or {}).items():
        if key in columns:
            test = lambda v, c=columns[key]: _typed(c, v)
        elif metadata is not None:
            test = lambda v, k=key: _variant(metadata, k, v)
        else:
            test = lambda v: F.lit(v is None)
        options = list(value) if isinstance(value, (list, tuple, set, frozenset)) else [value]
        parts.append(reduce(lambda a, b: a | b, map(test, options), F.lit(False)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))
