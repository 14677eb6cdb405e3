"""Joins that Spark lacks or spells awkwardly, built from joins, aggregates and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nestfold.plans.lineage import materialize


def _row(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: dict[str, str] | None = None, direction: str = "backward", tolerance: float | None = None, how: str = "left", tie: str | None = None, out: str = "match") -> DataFrame:
    """Each left row with the right row of nearest key at or before it ("backward"), or at or after it.

    One union and one window: both sides are sorted together by key and each left row takes
    the last right row before it. `by` maps left to right equality columns; without it the key
    is cut into ranges (see `_carried`), so that no task sorts everything. tolerance: matches
    further away are none. Of equal right keys the largest `tie` (smallest, forward) matches. The match is a struct column
    `out`, null without one; how="inner" drops such rows. Null keys match nothing.
    """
    by = by or {}
    back = direction == "backward"
    keys = [F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by)]
    keys_r = [F.col(f"`{c}`").alias(f"_by{k}") for k, c in enumerate(by.values())]
    names = [f"_by{k}" for k in range(len(by))]
    tied = F.col(tie) if tie else F.lit(0)
    l_row, r_row = _row(left), _row(right)
    kind_l, kind_r = left.select(l_row.alias("x")).schema["x"].dataType, right.select(r_row.alias("x")).schema["x"].dataType
    ls = left.select(*keys, F.col(left_on).alias("_key"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(tied.alias("t")).schema["t"].dataType).alias("_tie"), l_row.alias("_l"), F.lit(None).cast(kind_r).alias("_r"))
    rs = right.filter(F.col(right_on).isNotNull()).select(*keys_r, F.col(right_on).alias("_key"), F.lit(0).alias("_side"), tied.alias("_tie"), F.lit(None).cast(kind_l).alias("_l"), r_row.alias("_r"))
    both = ls.unionByName(rs)
    order = [F.col("_key").asc() if back else F.col("_key").desc(), F.col("_side"), F.col("_tie").asc() if back else F.col("_tie").desc()]
    if names:
        w = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        joined = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w))
    else:
        joined = _carried(both, order, back)
    joined = joined.filter("_side = 1")
    matched = F.col("_key").isNotNull()
    if tolerance is not None:
        gap = F.abs(F.col("_key").cast("double") - F.col(f"_m.`{right_on}`").cast("double"))
        matched = matched & (gap <= tolerance)
    joined = joined.withColumn("_m", F.when(matched, F.col("_m")))
    if how == "inner":
        joined = joined.filter("_m is not null")
    return joined.select("_l.*", F.col("_m").alias(out))


#: Rows of a range of `_carried`, about.
RANGE_ROWS = 500_000


def _carried(both: DataFrame, order: list[Column], back: bool) -> DataFrame:
    """The window of `asof_join` without equality keys: ranges of the key, and what each hands on.

    Ranges are cut at sampled keys, so that they are even however the keys lie, and there are as
    many as the rows ask for; rows of one key stay together. A range's last right row is one row;
    carrying those over all ranges is a window of one row a range.
    """
    ranges = max(1, both.count() // RANGE_ROWS)
    dealt = both.repartitionByRange(ranges, "_key").withColumn("_range", F.spark_partition_id())
    both = materialize(dealt)  # so that all that follows sees one cut
    w = Window.partitionBy("_range").orderBy(*order)
    own = both.withColumn("_own", F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # Right rows come before left ones of their key, in either direction.
    pick = F.max if back else F.min
    ends = both.filter("_side = 0").groupBy("_range").agg(pick(F.struct("_key", "_tie")).alias("_e"))
    last = both.filter("_side = 0").join(ends, "_range").filter((F.col("_key") == F.col("_e._key")) & F.col("_tie").eqNullSafe(F.col("_e._tie")))
    last = last.groupBy("_range").agg(F.first("_r").alias("_end"))
    every = both.select("_range").distinct().join(last, "_range", "left")
    step = F.col("_range").asc() if back else F.col("_range").desc()
    carry = every.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, -1)))
    return own.join(carry.select("_range", "_before"), "_range").withColumn("_m", F.coalesce("_own", "_before"))


def nest(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], name: str, how: str = "inner", order: list[str] | None = None) -> DataFrame:
    """Left rows with an array of their matches; how="left" keeps rows without any, with [].

    Right rows are collected before the join, so each left row meets one row.
    """
    row = _row(right)
    keyed = right.select(*[F.col(f"`{r}`").alias(f"_k{k}") for k, (_, r) in enumerate(on)], (F.struct(*[F.col(c) for c in order], row.alias("_row")) if order else F.struct(row.alias("_row"))).alias("_e"))
    keys = [f"_k{k}" for k in range(len(on))]
    found = keyed.groupBy(*keys).agg(F.collect_list("_e").alias("_es"))
    found = found.select(*keys, F.transform(F.array_sort("_es") if order else F.col("_es"), lambda e: e["_row"]).alias(name))
    cond = reduce(lambda a, b: a & b, [F.col(f"`{a}`") == F.col(f"_k{k}") for k, (a, _) in enumerate(on)])
    out = left.join(found, cond, "left" if how == "left" else "inner").drop(*keys)
    return out.withColumn(name, F.coalesce(name, F.array())) if how == "left" else out


def lateral(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], order: list[Column], n: int = 1, how: str = "inner") -> DataFrame:
    """Each left row with the first `n` right rows of its keys in `order`; how="left" keeps rows without any.

    LATERAL with ORDER BY and LIMIT in SQL is not this: Spark ranks the rows without the ORDER BY
    where that names a column that is not selected, and so takes whichever row a shuffle brings first.
    """
    ranked = right.withColumn("_rank", F.row_number().over(Window.partitionBy(*[F.col(f"`{r}`") for _, r in on]).orderBy(*order)))
    first = ranked.filter(F.col("_rank") <= n).drop("_rank")
    return left.join(first, reduce(lambda a, b: a & b, [left[a] == first[b] for a, b in on]), how)


def join_on_keys(left: DataFrame, keys: Column, right: DataFrame, right_key: str, how: str = "inner") -> DataFrame:
    """ON KEYS: each left row with the right rows whose key is in its key, or array of keys."""
    exploded = left.withColumn("_key", F.explode_outer(keys) if how == "left" else F.explode(keys))
    return exploded.join(right, F.col("_key") == right[right_key], how).drop("_key")


def nest_on_keys(left: DataFrame, keys: Column, right: DataFrame, right_key: str, name: str, id_col: str, how: str = "inner") -> DataFrame:
    """NEST ON KEYS: matches in the order of the keys; how="left" keeps rows without any, with []."""
    pairs = left.select(F.col(id_col).alias("_id"), F.posexplode(keys).alias("_pos", "_key"))
    found = pairs.join(right.select(F.col(right_key).alias("_key"), _row(right).alias("_row")), "_key")
    nested = found.groupBy("_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_row"))), lambda e: e["_row"]).alias(name))
    out = left.join(nested, left[id_col] == nested["_id"], "left" if how == "left" else "inner").drop("_id")
    return out.withColumn(name, F.coalesce(name, F.array())) if how == "left" else out


def unnest(df: DataFrame, array: Column, name: str, how: str = "inner", at: str | None = None) -> DataFrame:
    """A row for each element; how="left" keeps rows whose array is empty or null."""
    if at:
        return df.select("*", (F.posexplode_outer(array) if how == "left" else F.posexplode(array)).alias(at, name))
    return df.withColumn(name, F.explode_outer(array) if how == "left" else F.explode(array))


#: Rows of a block of `range_join`, about: left and right. A merge join keeps so few right rows of a key in memory as
#: they are, and a Parquet page (20,000 rows) holds their sequence many times.
RANGE_BLOCK = 65_536, 1_000
#: Comparisons of a task of `range_join`, about.
RANGE_PAIRS = 100_000_000


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float, by: list[tuple[str, str]] | None = None, how: str = "inner") -> DataFrame:
    """Left rows with the right intervals [low, high] that hold their point.

    Both sides are cut into bins of `width`, or of the mean interval where that is shorter, an
    interval once for each bin it touches, so the join has an equality key and is shuffled by it
    instead of comparing all rows with all. An inner join cuts what a bin holds of both sides into
    blocks, each two of them a key, so that no key grows with the input and tasks are as many as
    the comparisons ask for. Blocks are sorted, so that rows of one interval run meet in the same
    sequence again and again: pairs grow with the square of the input, and such columns take little space.
    """
    length = (F.col(high) - F.col(low)).cast("double")
    mean = right.agg(F.avg(F.when((length >= 0) & (length < float("inf")), length))).first()[0]
    width = width if mean is None else min(width, max(mean, width / 1024))
    by_l = [F.col(f"`{a}`").alias(f"_by{k}") for k, (a, _) in enumerate(by or [])]
    by_r = [F.col(f"`{b}`").alias(f"_by{k}") for k, (_, b) in enumerate(by or [])]
    keys = ["_bin", *[f"_by{k}" for k in range(len(by_l))]]
    at = lambda c: F.floor(F.col(c) / width)
    mine = left.select("*", *by_l, F.col(point).alias("_point"), at(point).alias("_bin"))
    bins = right.select("*", *by_r, F.col(low).alias("_low"), F.col(high).alias("_high"), F.explode(F.sequence(at(low), at(high))).alias("_bin"))
    if how != "inner":
        cond = reduce(lambda a, b: a & b, [mine[k] == bins[k] for k in keys]) & (F.col("_point") >= F.col("_low")) & (F.col("_point") <= F.col("_high"))
        return mine.join(bins, cond, how).drop(*keys, "_point", "_low", "_high")
    counted = mine.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nl")).join(bins.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nr")), keys)
    counted = materialize(counted)
    tasks = int((counted.agg(F.sum(F.col("_nl").cast("double") * F.col("_nr"))).first()[0] or 0) // RANGE_PAIRS) + 1
    cuts = counted.select(*keys, *[F.ceil(F.col(n) / most).cast("int").alias(c) for n, most, c in zip(("_nl", "_nr"), RANGE_BLOCK, ("_cl", "_cr"), strict=True)])

    def dealt(rows: DataFrame, columns: list[str], own: str, other: str, order: str) -> DataFrame:
        rows = rows.withColumn("_hash", F.xxhash64(*[F.col(f"`{c}`") for c in columns])).join(cuts, keys)
        rows = rows.withColumn(f"_in{own}", F.pmod("_hash", F.col(f"_c{own}")).cast("int")).withColumn(f"_in{other}", F.explode(F.sequence(F.lit(0), F.col(f"_c{other}") - 1)))
        rows = rows.drop("_hash", "_cl", "_cr").repartition(tasks, *keys, "_inl", "_inr")
        # The optimizer drops a sort below a join, but not a rank that is asked for.
        rank = F.row_number().over(Window.partitionBy(*keys, "_inl", "_inr").orderBy(order))
        return rows.withColumn("_rank", rank).filter("_rank > 0").drop("_rank")

    pairs = dealt(mine, left.columns, "l", "r", "_point").hint("merge").join(dealt(bins, right.columns, "r", "l", "_low"), [*keys, "_inl", "_inr"])
    return pairs.filter("_point >= _low AND _point <= _high").drop(*keys, "_inl", "_inr", "_point", "_low", "_high")


def salted_join(left: DataFrame, right: DataFrame, on: str, salts: int, how: str = "inner") -> DataFrame:
    """Equality join for a left side with hot keys: its rows are dealt to `salts` copies of the right rows.

    Only inner, left, left_semi and left_anti joins keep their meaning when the right side is repeated.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)))
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return dealt.join(many, [on, "_salt"], how).drop("_salt")
