"""Window features by rewriting: GROUPS frames, EXCLUDE, DISTINCT aggregates, values from the last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _spec(partition: list[str], order: list[Column | str]):
    return (Window.partitionBy(*partition) if partition else Window.partitionBy()).orderBy(*order)


def groups_frame(df: DataFrame, partition: list[str], order: list[Column | str], before: int | None, after: int | None, **aggs: Column) -> DataFrame:
    """GROUPS BETWEEN before PRECEDING AND after FOLLOWING; None is unbounded.

    Peer groups are numbered by DENSE_RANK; a RANGE frame over the number is the GROUPS frame.
    """
    numbered = df.withColumn("_g", F.dense_rank().over(_spec(partition, order)))
    low = Window.unboundedPreceding if before is None else -before
    high = Window.unboundedFollowing if after is None else after
    w = _spec(partition, ["_g"]).rangeBetween(low, high)
    return numbered.withColumns({n: a.over(w) for n, a in aggs.items()}).drop("_g")


def exclude_frame(df: DataFrame, partition: list[str], order: list[str], before: int | None, after: int | None, exclude: str, value: str, unique: str, out: str, agg: str = "sum", unit: str = "rows") -> DataFrame:
    """An aggregate (sum, count, min, max, avg) over a ROWS or GROUPS frame without current_row, group or ties.

    `unique` orders peers, so that the frame is well defined. NULL (0 for count) where
    nothing is left. Sums and counts of what is excluded are subtracted; only least and largest
    values collect their frame.
    """
    spec = _spec(partition, [*order, unique])
    numbered = df.withColumn("_g", F.dense_rank().over(_spec(partition, order))).withColumn("_rn", F.row_number().over(spec))
    low = Window.unboundedPreceding if before is None else -before
    high = Window.unboundedFollowing if after is None else after
    w = spec.rowsBetween(low, high) if unit == "rows" else _spec(partition, ["_g"]).rangeBetween(low, high)
    if agg in ("sum", "count", "avg") and (before is None or before >= 0) and (after is None or after >= 0):
        x = F.col(value).cast("double")
        peers = Window.partitionBy(*partition, "_g").orderBy(unique)
        peers = peers.rowsBetween(low, high) if unit == "rows" else peers.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def left(over, own: Column) -> Column:
            """An aggregate of the frame without that of the excluded rows."""
            out = over(w)
            if exclude in ("group", "ties"):
                out = out - over(peers)
            return out - own if exclude == "current_row" else out + own if exclude == "ties" else out

        n = left(lambda o: F.count(x).over(o), x.isNotNull().cast("long"))
        total = left(lambda o: F.coalesce(F.sum(x).over(o), F.lit(0.0)), F.coalesce(x, F.lit(0.0)))
        made = {"count": n, "sum": F.when(n > 0, total), "avg": F.when(n > 0, total / n)}[agg]
        return numbered.withColumn(out, made).drop("_g", "_rn")
    held = numbered.withColumn("_frame", F.collect_list(F.struct("_rn", "_g", F.col(value).alias("x"))).over(w))
    keep = {
        "current_row": lambda e: e["_rn"] != F.col("_rn"),
        "group": lambda e: e["_g"] != F.col("_g"),
        "ties": lambda e: (e["_g"] != F.col("_g")) | (e["_rn"] == F.col("_rn")),
        "no_others": lambda e: F.lit(True),
    }[exclude]
    xs = F.filter(F.transform(F.filter("_frame", keep), lambda e: e["x"]), lambda x: x.isNotNull())
    total = F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    made = {"count": F.size(xs).cast("long"), "sum": F.when(F.size(xs) > 0, total), "avg": F.try_divide(total, F.size(xs)), "min": F.array_min(xs), "max": F.array_max(xs)}[agg]
    return held.withColumn(out, made).drop("_g", "_rn", "_frame")


def ratio_to_report(x: Column, partition: list[str]) -> Column:
    return F.try_divide(x.cast("double"), F.sum(x.cast("double")).over(Window.partitionBy(*partition)))


def nth_from_last(value: str, n: int, partition: list[str], order: list[Column]) -> Column:
    """NTH_VALUE(x, n) FROM LAST over the whole partition: the order given must be the reverse one."""
    return F.nth_value(value, n).over(_spec(partition, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))


def distinct_over(agg: str, value: str, partition: list[str]) -> Column:
    """COUNT, SUM or AVG of the distinct values of a partition, on every row."""
    found = F.collect_set(value).over(Window.partitionBy(*partition))
    total = F.aggregate(found, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return {"count": F.size(found).cast("long"), "sum": F.when(F.size(found) > 0, total), "avg": F.try_divide(total, F.size(found))}[agg]


def top_per_group(df: DataFrame, partition: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before it shuffles them."""
    return df.withColumn("_rn", F.row_number().over(_spec(partition, order))).filter(F.col("_rn") <= n).drop("_rn")
