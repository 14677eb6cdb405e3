"""Distances of vectors as expressions; NULL for lengths that differ or a zero norm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scalar import _c


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def distance(a, b, metric: str = "l2") -> Column:
    """l2 or euclidean, l2_squared or euclidean_squared, dot (negated), cosine (one minus)."""
    a, b = _c(a), _c(b)
    if metric in ("l2", "euclidean", "l2_squared", "euclidean_squared"):
        square = _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))
        out = square if metric.endswith("squared") else F.sqrt(square)
    elif metric == "dot":
        out = -dot(a, b)
    elif metric == "cosine":
        out = 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    else:
        raise ValueError(f"no such metric: {metric}")
    return F.when(F.size(a) == F.size(b), out)


def top_k(vectors: DataFrame, query: list[float], k: int, metric: str = "cosine", vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """The k nearest to a query; ties by id. Arrow batches are compared as matrices and each task keeps
    k rows, so only those are sorted together. Vectors of another length or of no norm (cosine) are left out."""
    q = np.array(query, np.float64)
    name = metric.replace("euclidean", "l2")
    if name not in ("l2", "l2_squared", "dot", "cosine"):
        raise ValueError(f"no such metric: {metric}")

    def measure(m: np.ndarray) -> np.ndarray:
        if name == "dot":
            return -(m @ q)
        if name == "cosine":
            with np.errstate(divide="ignore", invalid="ignore"):
                return 1 - (m @ q) / (np.sqrt((m * m).sum(1)) * np.sqrt(q @ q))
        square = ((m - q) ** 2).sum(1)
        return square if name == "l2_squared" else np.sqrt(square)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), len(q)), False))
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            found = pa.table({id_col: batch.column(0), "distance": measure(flat.reshape(batch.num_rows, len(q)))})
            found = found.filter(pc.is_finite(found["distance"]))
            best = pa.concat_tables([best, found]) if best is not None else found
            best = best.sort_by([("distance", "ascending"), (id_col, "ascending")]).slice(0, k)
        if best is not None:
            yield from best.combine_chunks().to_batches()

    slim = vectors.select(id_col, vector)
    near = slim.mapInArrow(run, slim.drop(vector).schema.add("distance", "double"))
    return near.orderBy("distance", id_col).limit(k)


def ivf_cells(vectors: DataFrame, centres: list[list[float]], vector: str = "embedding") -> DataFrame:
    """`vectors` with `cell`, the index of the nearest centre: write it partitioned or bucketed by cell to probe it."""
    return vectors.withColumn("cell", nearest(F.col(vector), centres)["index"])


def ivf_census(cells: DataFrame) -> DataFrame:
    """cell and n, how many vectors it holds."""
    return cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def ivf_probe(cells: DataFrame, centres: list[list[float]], query: list[float], k: int, probes: int, metric: str = "l2", vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """`top_k` of the `probes` cells whose centres are nearest to the query; other cells are not read."""
    far = [sum((a - b) ** 2 for a, b in zip(c, query, strict=True)) for c in centres]
    near = sorted(range(len(centres)), key=far.__getitem__)[:probes]
    return top_k(cells.filter(F.col("cell").isin(near)), query, k, metric, vector, id_col)


def nearest(vector, centroids: list[list[float]], metric: str = "l2") -> Column:
    """struct(distance, index) of the nearest of a few centroids; ties by index."""
    made = [F.struct(distance(vector, F.array(*[F.lit(float(x)) for x in c]), metric).alias("distance"), F.lit(k).alias("index")) for k, c in enumerate(centroids)]
    return F.array_min(F.array(*made))


def vectorize(text, size: int = 8) -> Column:
    """A deterministic stand-in for an embedding service: hashed features in [-1, 1]."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.pmod(F.xxhash64(_c(text), k), F.lit(2001)) / 1000.0 - 1)


def kmeans(vectors: DataFrame, k: int, rounds: int = 10, vector: str = "embedding", id_col: str = "vec_id") -> list[list[float]]:
    """Lloyd's centroids from the k vectors of least id; only k centroids reach the driver a round."""
    centres = [list(map(float, r[0])) for r in vectors.orderBy(id_col).select(vector).limit(k).collect()]
    for _ in range(rounds):
        placed = vectors.select(vector, nearest(F.col(vector), centres).alias("near")).select(F.col("near.index").alias("index"), F.posexplode(vector))
        found = placed.groupBy("index", "pos").agg(F.avg("col").alias("x")).groupBy("index").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).collect()
        new = list(centres)
        for row in found:
            new[row["index"]] = [e["x"] for e in row["v"]]
        if new == centres:
            break
        centres = new
    return centres
