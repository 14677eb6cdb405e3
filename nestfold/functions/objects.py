"""Objects as maps: names in order, and functions that return a changed copy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c


def length(m) -> Column:
    return F.when(_c(m).isNotNull(), F.size(_c(m)))


def names(m) -> Column:
    return F.array_sort(F.map_keys(_c(m)))


def pairs(m) -> Column:
    return F.array_sort(F.map_entries(_c(m)))


def values(m) -> Column:
    """Values in the order of their names."""
    return F.transform(pairs(m), lambda e: e["value"])


def put(m, key, value) -> Column:
    """Sets a field, replacing what was there."""
    k = _c(key)
    return F.map_concat(F.map_filter(_c(m), lambda n, _: n != k), F.create_map(k, _c(value)))


def add(m, key, value) -> Column:
    """Adds a field only where it is absent."""
    return F.when(F.map_contains_key(_c(m), key), _c(m)).otherwise(put(m, key, value))


def remove(m, *keys: str) -> Column:
    return F.map_filter(_c(m), lambda n, _: ~n.isin(*keys))


def concat(a, b) -> Column:
    """Fields of both; of equal names the right one's."""
    return F.map_concat(F.map_filter(_c(a), lambda n, _: ~F.map_contains_key(_c(b), n)), _c(b))
