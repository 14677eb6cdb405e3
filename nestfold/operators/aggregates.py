"""Aggregates with the engine's semantics, on built-in (partial and final) aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BARS = "▁▂▃▄▅▆▇█"


def sum_(x: Column) -> Column:
    """Always a double."""
    return F.sum(x.cast("double"))


def countn(x: Column) -> Column:
    """Values that are numbers, for columns of text too."""
    return F.count(x.try_cast("double"))


def array_agg(x: Column, order: Column | None = None) -> Column:
    """Keeps nulls; with `order` the array is in that order."""
    if order is None:
        return F.transform(F.collect_list(F.struct(x.alias("x"))), lambda e: e["x"])
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda e: e["x"])


def array_agg_distinct(x: Column) -> Column:
    return F.array_sort(F.collect_set(x))


def min_by(ret: Column, key: Column) -> Column:
    """Of rows with the least key the least value; null keys are skipped."""
    return F.min(F.when(key.isNotNull(), F.struct(key.alias("k"), ret.alias("r"))))["r"]


def max_by(ret: Column, key: Column) -> Column:
    return F.max(F.when(key.isNotNull(), F.struct(key.alias("k"), ret.alias("r"))))["r"]


def geomean(x: Column) -> Column:
    """exp of the mean logarithm of the positive values."""
    return F.exp(F.avg(F.when(x > 0, F.ln(x))))


def decimal_sum(x: Column, scale: int = 18) -> Column:
    """Exact sum of decimal texts, decimals or numbers (by their shortest text), with `scale` places.

    Values that are no numbers are skipped; NULL where the sum has more than 38 digits. A value of
    more than `scale` places raises instead of being rounded.
    """
    kind = f"decimal(38,{scale})"
    text = x.cast("string")
    found = text.try_cast(kind)
    cut = F.length(F.regexp_extract(text, r"\.([0-9]*?)0*$", 1)) > scale
    return F.try_sum(F.when(cut, F.raise_error(F.concat(F.lit(f"more than {scale} decimal places: "), text)).cast(kind)).otherwise(found))


def hll(x: Column) -> Column:
    return F.hll_sketch_estimate(F.hll_sketch_agg(x))


def group_as(df: DataFrame, order: str) -> Column:
    """GROUP AS: the group's rows as an array of structs, in order of a column."""
    return F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(c) for c in df.columns if c != order])))


def bins(df: DataFrame, group: list[str], value: str, low: str, high: str, n: int) -> DataFrame:
    """group columns, bin (0 to n - 1) and count of values, for group-wise ranges [low, high]."""
    at = F.least(F.floor(F.try_divide(F.col(value) - F.col(low), F.col(high) - F.col(low)) * n), F.lit(n - 1))
    return df.filter(F.col(value).isNotNull()).groupBy(*group, F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def _chart(heights: Column) -> Column:
    """One block character for each number, scaled from least to largest."""

    def draw(e: Column) -> Column:  # bounds are fields of one element, so that they are found once
        level = lambda x: F.coalesce(F.floor(F.try_divide(x - e["low"], e["high"] - e["low"]) * (len(BARS) - 1) + 0.5), F.lit(0))
        return F.array_join(F.transform(e["hs"], lambda x: F.substring(F.lit(BARS), level(x).cast("int") + 1, F.lit(1))), "")

    once = F.struct(heights.alias("hs"), F.array_min(heights).alias("low"), F.array_max(heights).alias("high"))
    return F.get(F.transform(F.array(once), draw), 0)


def sparkline(x: Column, order: Column) -> Column:
    """Block characters of the values in an order; nulls are left out."""
    kept = F.collect_list(F.when(x.isNotNull(), F.struct(order.alias("o"), x.cast("double").alias("x"))))
    return _chart(F.transform(F.array_sort(kept), lambda e: e["x"]))


def histogram(df: DataFrame, group: list[str], value: str, n: int = 20) -> DataFrame:
    """group columns and a block-character histogram of n bins; values are counted, not collected."""
    edge = df.groupBy(*group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    joined = df.join(edge, group) if group else df.crossJoin(F.broadcast(edge))
    counted = bins(joined, [*group, "_low", "_high"], value, "_low", "_high", n)
    held = counted.groupBy(*group).agg(F.map_from_entries(F.collect_list(F.struct("bin", "count"))).alias("_m"))
    heights = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.col("_m")[k], F.lit(0)).cast("double"))
    return held.select(*group, _chart(heights).alias("histogram"))


def census(df: DataFrame, variant: str) -> DataFrame:
    """path, type and count of the top-level fields of a variant column."""
    from nestfold.functions import variants

    fields = df.select(F.explode(F.map_entries(F.try_variant_get(F.col(variant), "$", "map<string,variant>"))).alias("e"))
    return fields.groupBy(F.col("e.key").alias("path"), variants.kind(F.col("e.value")).alias("val_type")).agg(F.count(F.lit(1)).alias("n"))


def vega_lite(df: DataFrame, x: str, y: str, mark: str = "bar") -> DataFrame:
    """A Vega-Lite chart of an aggregated (small) table, as one JSON text."""
    values = F.array_sort(F.collect_list(F.struct(F.col(x), F.col(y))))
    axis = lambda name: F.struct(F.lit(name).alias("field"))
    return df.agg(F.to_json(F.struct(F.lit(mark).alias("mark"), F.struct(values.alias("values")).alias("data"), F.struct(axis(x).alias("x"), axis(y).alias("y")).alias("encoding"))).alias("spec"))
