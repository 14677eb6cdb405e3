"""Set operations by column name, ordered merges and recursion to a fixpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestfold.plans.lineage import materialize


def union_all(*frames: DataFrame) -> DataFrame:
    """By name; a column that a branch lacks is MISSING (null) there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union(*frames: DataFrame) -> DataFrame:
    return union_all(*frames).distinct()


def _same(a: DataFrame, b: DataFrame) -> DataFrame:
    return b.select(*a.columns)


def intersect(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.intersectAll(_same(a, b)) if all else a.intersect(_same(a, b))


def except_(a: DataFrame, b: DataFrame, all: bool = False) -> DataFrame:
    return a.exceptAll(_same(a, b)) if all else a.subtract(_same(a, b))


def merge_scan(key: str, *frames: DataFrame) -> DataFrame:
    """Sorted inputs as one sorted output; rows without a key are skipped."""
    return union_all(*frames).filter(F.col(key).isNotNull()).orderBy(key)


def late_rows(df: DataFrame, key: str, position: str, bound: float, by: list[str]) -> DataFrame:
    """Rows whose key lies more than `bound` below a key that came earlier in their source."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_high", F.max(key).over(w)).filter(F.col("_high") - F.col(key) > bound).drop("_high")


class LateRows(ValueError):
    """Rows came further out of order than the bound allows."""


def ordered_merge(key: str, position: str, bound: float, frames: dict[str, DataFrame], late: str = "error") -> DataFrame:
    """`merge_scan` of nearly sorted sources. Rows beyond the bound raise (late="error") or are merged all the same ("widen")."""
    every = union_all(*[f.withColumn("_source", F.lit(n)) for n, f in frames.items()])
    if late == "error" and not (bad := late_rows(every, key, position, bound, ["_source"])).isEmpty():
        raise LateRows(f"{bad.count()} rows lie more than {bound} out of order")
    return every.filter(F.col(key).isNotNull()).orderBy(key, "_source", position)


class TooDeep(RecursionError):
    """A recursion has not ended within its levels."""


def recursive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], levels: int = 100, distinct: bool = True, key: list[str] | None = None) -> DataFrame:
    """WITH RECURSIVE: `step` makes new rows of the last level's rows, until there are none.

    distinct: rows (by `key`, else whole) that were there before are dropped, which ends cycles.
    Each level is written into the shared folder, so plans stay short. Raises `TooDeep` if there
    are new rows after `levels` levels: nothing is left out in silence.
    """
    found = seed.distinct() if distinct else seed
    level = found = materialize(found)
    for _ in range(levels):
        new = step(level).select(*found.columns)
        if distinct:
            new = new.dropDuplicates(key) if key else new.distinct()
            on = key or found.columns
            new = new.join(found.select(*on), [new[c].eqNullSafe(found[c]) for c in on], "left_anti")
        level = materialize(new)
        if level.isEmpty():
            break
        found = found.union(level)
    else:
        raise TooDeep(f"there are new rows after {levels} levels")
    return found
