"""Connected components by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, release


def components(edges: DataFrame) -> DataFrame:
    """node and label (the component's least node) of every node of edges (a, b), integers.

    Loops and repeated edges count once; null ends drop out. Each round shuffles edges and
    hangs nodes on smaller neighbours; rounds grow with the logarithm of a component's size.
    A node of very many edges is sent to its edges, so no hub fills a task.
    """
    e = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark, n = None, e.count()
    while True:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("deg")).select("u", F.least("u", "m").alias("m"), "deg")
        large = join_groups(both, least, ["u"], "deg", 2 * n).filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("deg"))
        small = join_groups(large, low, ["a"], "deg", 2 * n).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        release(e)
        e = new
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        n = now[0]
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("b").alias("node")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots.select("node", F.col("node").alias("label")))
