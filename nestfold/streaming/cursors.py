"""Cursors: what is new in files that grow, and what changed between two snapshots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class AppendCursor:
    """A named position in a folder of files. `advance` hands each new file's rows on once (at least).

    The position is a Structured Streaming checkpoint; a run that fails before its batch is done
    sees the batch again.
    """

    spark: SparkSession
    path: str
    schema: StructType
    checkpoint: str
    format: str = "json"

    def _stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).format(self.format).load(self.path)

    def advance(self, sink: str) -> DataFrame:
        """Move new rows into the Parquet table `sink`, and return the whole sink."""
        query = self._stream().writeStream.format("parquet").option("checkpointLocation", self.checkpoint).option("path", sink).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return self.spark.read.schema(self.schema).parquet(sink)

    def each(self, handle) -> None:
        """Call `handle(batch, batch_id)` on what is new, then move on."""
        query = self._stream().writeStream.foreachBatch(handle).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


def diff(old: DataFrame, new: DataFrame, id_col: str) -> DataFrame:
    """id and op (insert, update, delete) of rows that differ; equality is of all columns by value."""
    canon = lambda df: df.select(F.col(id_col).alias("id"), F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).alias("v"))
    a, b = canon(old).alias("a"), canon(new).alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id"), "full")
    op = F.when(F.col("a.id").isNull(), "insert").when(F.col("b.id").isNull(), "delete").when(~F.col("a.v").eqNullSafe(F.col("b.v")), "update")
    return joined.select(F.coalesce("a.id", "b.id").alias("id"), op.alias("op")).filter("op is not null")


def anomalies(old: DataFrame, new: DataFrame) -> DataFrame:
    """file and kind (truncated, rewritten, rotated) of files (file, size, head) that did not merely grow."""
    a, b = old.alias("a"), new.alias("b")
    kind = F.when(F.col("b.file").isNull(), "rotated").when(F.col("b.size") < F.col("a.size"), "truncated").when(F.col("a.head") != F.col("b.head"), "rewritten")
    joined = a.join(b, F.col("a.file") == F.col("b.file"), "left")
    return joined.select(F.col("a.file").alias("file"), kind.alias("kind")).filter("kind is not null")


def follow_sessions(stream: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Sessions of a stream: start, end and count; rows later than `late` are dropped, as Spark does."""
    w = F.session_window(time, gap)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select("session_window.start", "session_window.end", *by, "n")


def windowed_counts(stream: DataFrame, time: str, size: str, late: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Counts of a stream in tumbling (or, with `slide`, hopping) windows."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n")).select("window.start", "window.end", *by, "n")
