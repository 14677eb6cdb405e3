"""Array functions, comprehensions and paths into arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import _c

Fn = Callable[[Column], Column]


def length(a) -> Column:
    return F.when(_c(a).isNotNull(), F.size(_c(a)))


def count(a) -> Column:
    """Elements that are not null."""
    return F.when(_c(a).isNotNull(), F.size(F.filter(_c(a), lambda x: x.isNotNull())))


def total(a) -> Column:
    """Sum as a double; 0 for an empty array, NULL for a null one."""
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + F.coalesce(x.cast("double"), F.lit(0.0)))


def average(a) -> Column:
    return F.try_divide(total(a), count(a))


def minimum(a) -> Column:
    return F.array_min(_c(a))


def maximum(a) -> Column:
    return F.array_max(_c(a))


def contains(a, x) -> Column:
    return F.array_contains(_c(a), x)


def position(a, x) -> Column:
    """0-based, -1 without a match."""
    return F.array_position(_c(a), x) - 1


def append(a, *xs) -> Column:
    out = _c(a)
    for x in xs:
        out = F.array_append(out, x)
    return out


def prepend(x, a) -> Column:
    return F.array_prepend(_c(a), x)


def concat(*arrays) -> Column:
    return F.concat(*map(_c, arrays))


def sort(a) -> Column:
    return F.sort_array(_c(a))


def reverse(a) -> Column:
    return F.reverse(_c(a))


def flatten(a, depth: int = 1) -> Column:
    out = _c(a)
    for _ in range(depth):
        out = F.flatten(out)
    return out


def distinct(a) -> Column:
    return F.array_distinct(_c(a))


def span(first, until, step: int = 1) -> Column:
    """first, first + step, ... before `until`."""
    first, until = _c(first).cast("long"), _c(until).cast("long")
    last = until - (1 if step > 0 else -1)
    some = first <= last if step > 0 else first >= last
    return F.when(some, F.sequence(first, F.when(some, last).otherwise(first), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def element(a, k) -> Column:
    """0-based, negative from the end, NULL outside."""
    a, k = _c(a), _c(k)
    return F.get(a, F.when(k < 0, F.size(a) + k).otherwise(k).cast("int"))


def part(a, first: int, until: int | None = None) -> Column:
    """a[first:until], 0-based."""
    a = _c(a)
    return F.slice(a, first + 1, F.greatest((F.size(a) if until is None else F.least(F.size(a), F.lit(until))) - first, F.lit(0)))


def any_satisfies(a, p: Fn) -> Column:
    return F.coalesce(F.exists(_c(a), p), F.lit(False))


def every_satisfies(a, p: Fn) -> Column:
    return F.coalesce(F.forall(_c(a), p), F.lit(False))


def any_and_every(a, p: Fn) -> Column:
    return every_satisfies(a, p) & (F.size(_c(a)) > 0)


def first_for(a, f: Fn, when: Fn | None = None) -> Column:
    return F.get(array_for(a, f, when), 0)


def array_for(a, f: Fn, when: Fn | None = None) -> Column:
    return F.transform(F.filter(_c(a), when) if when else _c(a), f)


def object_for(a, key: Fn, value: Fn, when: Fn | None = None) -> Column:
    """OBJECT k:v FOR x IN a WHEN p END; of equal keys the last stays."""
    pairs = array_for(a, lambda x: F.struct(key(x).alias("k"), value(x).alias("v")), when)
    last = F.filter(F.transform(pairs, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.exists(F.slice(pairs, e["i"] + 2, F.greatest(F.size(pairs) - e["i"] - 1, F.lit(0))), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))
