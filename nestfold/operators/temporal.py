"""Events in order: sessions, transitions and the rows around a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessionize(df: DataFrame, partition: list[str], order: str, gap: float, tie: str, out: str = "session") -> DataFrame:
    """Numbers a partition's sessions from 1; a row more than `gap` after the one before begins a new one."""
    w = Window.partitionBy(*partition).orderBy(order, tie)
    new = F.coalesce((F.col(order).cast("double") - F.lag(order).over(w).cast("double") > gap).cast("int"), F.lit(1))
    return df.withColumn("_new", new).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def transitions(df: DataFrame, of: str, partition: list[str], order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before, with it as `from` and their own as `to`."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("from", F.lag(of).over(w)).withColumn("_n", F.row_number().over(w)).withColumn("to", F.col(of))
    return marked.filter((F.col("_n") > 1) & ~F.col("from").eqNullSafe(F.col("to"))).drop("_n")


def grep_context(df: DataFrame, when: Column, before: int, after: int, partition: list[str], order: list[str], out: str = "is_match") -> DataFrame:
    """Matching rows with `before` rows ahead of each and `after` behind, every row once."""
    w = Window.partitionBy(*partition).orderBy(*order)
    hit = F.coalesce(when, F.lit(False))
    near = F.max(F.col(out).cast("int")).over(w.rowsBetween(-after, before))
    return df.withColumn(out, hit).withColumn("_near", near).filter("_near = 1").drop("_near")
