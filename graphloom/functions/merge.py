"""Deep merges of JSON objects: on the driver and as a column."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def merge(x: Any, y: Any) -> Any:
    """Objects by key, recursively; elsewhere the left value unless it is missing."""
    if isinstance(x, dict) and isinstance(y, dict):
        return {k: merge(x[k], y[k]) if k in x and k in y else x.get(k, y.get(k)) for k in {**y, **x}}
    return y if x is None else x


def merged(x: Column, y: Column, depth: int = 6) -> Column:
    """merge() of two VARIANT columns, in built-in functions: objects are merged down to depth levels, below which the left one stays.

    Null columns and JSON null count as missing.
    """
    there = lambda v: F.when(~F.is_variant_null(v), v)
    x, y = there(x), there(y)
    if not depth:
        return F.coalesce(x, y)
    # Only objects can be read as maps.
    a, b = (F.try_variant_get(v, "$", "map<string,variant>") for v in (x, y))
    both = F.map_zip_with(a, b, lambda k, p, q: merged(p, q, depth - 1))
    return F.when(a.isNotNull() & b.isNotNull(), F.to_variant_object(both)).otherwise(F.coalesce(x, y))


def merged_maps(x: Column, y: Column) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.map_zip_with(F.coalesce(x, empty), F.coalesce(y, empty), lambda k, a, b: F.coalesce(a, b))
