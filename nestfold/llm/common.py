"""What the operators of this subpackage share: reading, cutting lineage, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nestfold.plans.lineage import materialize  # noqa: F401  (used by the operators)

#: Arrow batches to Python workers stay under this many bytes, whatever the length of texts.
BATCH_BYTES = 8 << 20

#: A table is broadcast only when it was counted and found to be at most this large.
BROADCAST_BYTES = 16 << 20

#: A run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(df: DataFrame) -> None:
    """Delete the files of a materialized table that no plan reads any more."""
    spark = df.sparkSession
    for at in {f.rpartition("/")[0] for f in df.inputFiles() if "/nestfold-" in f}:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(at)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that very long texts do not add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) != str(BATCH_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast a counted table if it is small; otherwise leave the join to shuffle and AQE."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


#: A group of more rows is joined where its rows are; smaller ones meet by key.
HOT_ROWS = 200_000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, n: int, row_bytes: int = 80, count: int | None = None) -> DataFrame:
    """Inner join of `rows` (`n` of them at most) with one row a group, nulls equal.

    `size` is the group's row count. Groups counted to be few are broadcast. Else groups of more
    than `cap` rows are sent to every task instead of their rows being shuffled by key, so no key
    fills a task. At most n / cap groups are that large, so that groups of `row_bytes` each stay
    within BROADCAST_BYTES whatever the data; where n is no more than cap there is none.
    """
    cap = max(HOT_ROWS, n * row_bytes // BROADCAST_BYTES)
    named = groups.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in groups.columns if c not in keys])
    same = lambda: [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    drop = [f"_k_{k}" for k in keys]
    if count is not None and count * row_bytes <= BROADCAST_BYTES:
        return rows.join(F.broadcast(named), same()).drop(*drop)
    if n <= cap:
        return rows.join(named, same()).drop(*drop)
    hot, cold = named.filter(F.col(size) > cap), named.filter(F.col(size) <= cap)
    there = rows.join(F.broadcast(hot), same())
    rest = rows.join(F.broadcast(hot.select(*drop)), same(), "left_anti").join(cold, same())
    return there.drop(*drop).unionByName(rest.drop(*drop))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parts_for(rows: int, each: int) -> int:
    """Number of parts so that one holds about `each` rows."""
    return max(1, -(-rows // each))


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str, rows: int, each: int = 200_000) -> DataFrame:
    """Number the rows of each group gaplessly from 0 without bringing a group into one task.

    Rows go to pieces by a hash of `order`; a window numbers within (group, piece) and the
    counts of pieces give the offsets. `rows` is the table's row count.
    """
    n = parts_for(rows, each)
    by = [*group, "_piece"]
    df = df.withColumn("_piece", F.pmod(F.xxhash64(*order), F.lit(n)).cast("int"))
    from pyspark.sql import Window

    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*by).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(within) - 1)
        .join(counts, by)
        .withColumn(out, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_piece", "_rn", "_off")
    )
