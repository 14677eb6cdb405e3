"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A source's target over its size is the number of copies its words are due. The whole part is
allocated for certain; the rest is sampled with unequal probability: a document's inclusion odds
are its source's odds, tilted towards short documents by the square root of its length against
the source's mean (within TILT), so that a few very long texts do not make up a sample. Documents
are ranked by the odds of a random number divided by their inclusion odds, and the first ones
are taken as long as their words fit what the source still lacks; the first that does not fit is
passed over, and the documents of any later rank that come nearest to what is left close the gap:
a sample of fixed size in words. Where to cut each source is found from a histogram of ranks
and one small window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

#: Bins of a source's rank histogram; a bin's documents, 1/BINS of the source's, are ordered exactly.
BINS = 1 << 16
#: Inclusion odds are tilted at most this much, up or down.
TILT = 2.0
#: Documents of later rank that may close the gap.
FILL = 2


def random_number(doc_id: Column, text: Column, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the document alone, so that reruns agree."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(str(seed)))
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """_source, source_size and target of a table (_source, source_size) of one row a source.

    Sources by code point, null last, take `weights` in turn and share `share` of all sizes.
    A target stops at `most` times the source's size and the excess is reshared by weight:
    the targets are min(most * size, level * weight) for the one level that gives the right
    sum. The windows see one row a source.
    """
    by_name = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    w = F.lit(weights[-1])
    for k, x in enumerate(weights[:-1]):
        w = F.when(F.col("_turn") == k, x).otherwise(w)
    sized = sizes.withColumn("_turn", (F.row_number().over(by_name) - 1) % len(weights)).withColumn("_w", w.cast("double"))
    sized = sized.withColumn("_full", F.col("source_size") * most).withColumn("_ratio", F.col("_full") / F.col("_w"))
    up = Window.orderBy("_ratio", F.col("_source").isNull(), "_source")
    all_rows = Window.partitionBy()
    before = F.coalesce(F.sum("_full").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("_w").over(up.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(all_rows) * share - before) / left
    sized = sized.withColumn("_level", level).withColumn("_k", F.row_number().over(up))
    first = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_k", "_level"))).over(all_rows)
    sized = sized.withColumn("_level", first["_level"])
    target = F.coalesce(F.least(F.col("_full"), F.col("_level") * F.col("_w")), F.col("_full"))
    return sized.select("_source", "source_size", target.alias("target"))


def with_rank(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds _copies (certain) and _q (random odds over inclusion odds; null if nothing is left to sample)."""
    due = F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))
    chance = F.col("_due") - F.col("_copies")
    mean = F.col("source_size").cast("double") / F.col("source_rows").cast("double")
    tilt = F.greatest(F.lit(1 / TILT), F.least(F.lit(TILT), F.sqrt(F.try_divide(mean, F.col("_size").cast("double")))))
    odds = F.when(chance > 0, chance / (1 - chance)) * tilt
    q = F.col("_u") / (1 - F.col("_u"))
    joined = docs.join(plan.withColumnRenamed("_source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    return joined.withColumn("_due", due).withColumn("_copies", F.floor("_due")).withColumn("_q", F.try_divide(q, odds)).drop("_due")


def _slim(docs: DataFrame, id_col: str, text: str, source: str, seed: int) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source).alias("_source"),
        word_count(F.col(text)).alias("_size"),
        random_number(F.col(id_col), F.col(text), seed).alias("_u"),
    )


def mixing_plan(slim: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row a source: _source, source_size, source_rows, target, _cut (ranks below it are sampled) and _fill (ranks that close the gap).

    slim: _source, _size and _u, materialized. Per-source sums are combined before they are
    shuffled; the histogram has at most BINS rows a source, so no source's documents meet in one
    task. The plan's windows see one row a source. Equal ranks (fully repeated rows) are taken or
    left together.
    """
    sizes = slim.groupBy("_source").agg(F.sum("_size").alias("source_size"), F.count(F.lit(1)).alias("source_rows"))
    targets = source_targets(sizes, weights, share, most).join(sizes.select(F.col("_source").alias("_of"), "source_rows"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    targets = materialize(targets)
    ranked = with_rank(slim, targets).filter(F.col("_q").isNotNull() & (F.col("_size") > 0))
    ranked = ranked.withColumn("_bin", F.floor(F.col("_q") / (1 + F.col("_q")) * BINS))
    up = Window.partitionBy("_source").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = ranked.groupBy("_source", "_bin").agg(F.sum("_size").alias("_in"), F.first("target").alias("target"), F.first("source_size").alias("source_size"), F.first("_copies").alias("_copies"))
    bins = bins.withColumn("_before", F.coalesce(F.sum("_in").over(up), F.lit(0)))
    rest = F.col("target") - F.col("_copies") * F.col("source_size")
    crossing = bins.filter((F.col("_before") <= rest) & (F.col("_before") + F.col("_in") > rest))
    crossing = materialize(crossing.select(F.col("_source").alias("_of"), F.col("_bin").alias("_at"), "_before", rest.alias("_rest")))
    here = ranked.join(crossing, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_bin") == F.col("_at")))
    by_rank = here.groupBy("_of", "_before", "_rest", "_q").agg(F.sum("_size").alias("_in"))
    running = Window.partitionBy("_of").orderBy("_q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_rank = by_rank.withColumn("_sum", F.col("_before") + F.sum("_in").over(running))
    # The first rank that does not fit; there is one, as the bin's last sum is beyond the rest.
    over = by_rank.filter(F.col("_sum") > F.col("_rest")).groupBy("_of").agg(F.min(F.struct("_q", (F.col("_rest") - F.col("_sum") + F.col("_in")).alias("_gap"))).alias("_b"))
    plan = materialize(over.select("_of", F.col("_b._q").alias("_cut"), F.col("_b._gap").alias("_gap"), F.array().cast("array<double>").alias("_fill")))
    for _ in range(FILL):
        later = ranked.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).filter((F.col("_q") >= F.col("_cut")) & ~F.array_contains("_fill", F.col("_q")))
        off = F.abs(F.col("_gap") - F.col("_size"))
        best = later.filter(off < F.abs("_gap")).groupBy("_of").agg(F.min(F.struct(off.alias("_off"), "_q", "_size")).alias("_b"))
        best = best.select(F.col("_of").alias("_to"), "_b")
        plan = plan.join(best, F.col("_of").eqNullSafe(F.col("_to")), "left")
        fill = F.when(F.col("_b").isNull(), F.col("_fill")).otherwise(F.concat("_fill", F.array("_b._q")))
        plan = materialize(plan.select("_of", "_cut", (F.col("_gap") - F.coalesce(F.col("_b._size"), F.lit(0))).alias("_gap"), fill.alias("_fill")))
    return targets.join(plan.drop("_gap"), F.col("_source").eqNullSafe(F.col("_of")), "left").drop("_of")


def copies(ranked: DataFrame) -> Column:
    """Copies of a row of `with_rank` under the plan's cuts."""
    sampled = (F.col("_q") < F.col("_cut")) | F.array_contains("_fill", F.col("_q"))
    return F.col("_copies") + F.coalesce(sampled, F.lit(False)).cast("long")


def mix_sizes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """id_col, size, source_size, target, copies and taken (words taken, repeats counted) of every row.

    Null text: size 0, which takes 0. Null sources form one source, ordered last. Rows with
    null or repeated ids stand for themselves; rows that agree in id, text and source are taken
    or left together. If all sizes are 0, so are all targets. An empty table gives an empty one;
    other columns are ignored, whatever their names.
    """
    slim = materialize(_slim(docs, id_col, text, source, seed))
    plan = materialize(mixing_plan(slim, weights, share, most))
    out = with_rank(slim, plan)
    n = copies(out).cast("long")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", n.alias("copies"), (n * F.col("_size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The rows of `docs`, each as often as `mix_sizes` says; the plan is one row a source, so texts are not shuffled by id."""
    plan = materialize(mixing_plan(materialize(_slim(docs, id_col, text, source, seed)), weights, share, most))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.col(source).alias("_source"),
        word_count(F.col(text)).alias("_size"),
        random_number(F.col(id_col), F.col(text), seed).alias("_u"),
    )
    ranked = with_rank(rows, plan)
    many = ranked.select("_row", copies(ranked).cast("int").alias("_n")).filter("_n > 0")
    return many.select("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_c")).select("_row.*")
