"""Folders as catalogs: names for files, and sinks that write new ones."""

from __future__ import annotations

import json
import os
import re
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from nestfold.plans.lineage import materialize

from .readers import READERS, extension, read


def discover(root: str, only: set[str] | None = None) -> dict[str, str]:
    """Table name -> path. A file is a table; so is a folder of files of one kind, or namespace/table/files."""
    out: dict[str, str] = {}

    def kinds(folder: Path) -> list[str]:
        found = [extension(p.name) for p in folder.iterdir() if p.is_file() and not p.name.startswith((".", "_")) and not p.name.endswith(".zst")]
        return sorted({k for k in found if k in READERS and (not only or k in only)})

    def name(*parts: str) -> str:
        return re.sub(r"\W", "_", "_".join(p for p in parts if p != "default"))

    base = Path(root)
    for p in sorted(base.iterdir()):
        if p.is_file() and not p.name.startswith((".", "_")) and not p.name.endswith(".zst") and extension(p.name) in READERS and (not only or extension(p.name) in only):
            out[name(p.name.split(".")[0])] = str(p)
        elif p.is_dir():
            if p.suffix == ".parquet":
                out[name(p.stem)] = str(p)
            for k in kinds(p) if p.suffix != ".parquet" else []:
                out[name(p.name) if len(kinds(p)) == 1 else name(p.name, k)] = f"{p}/*.{k}*"
            for q in sorted(x for x in p.iterdir() if x.is_dir()) if p.suffix != ".parquet" else []:
                for k in kinds(q):
                    out[name(p.name, q.name) if len(kinds(q)) == 1 else name(p.name, q.name, k)] = f"{q}/*.{k}*"
    return out


def load_sources(path: str) -> dict[str, str]:
    """A sources file (JSON, YAML or TOML): table name -> path, relative to the file."""
    text = Path(path).read_text()
    if path.endswith(".toml"):
        found = tomllib.loads(text)
    elif path.endswith((".yaml", ".yml")):
        import yaml

        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    found = found.get("sources", found)
    return {n: p if "://" in p or os.path.isabs(p) else os.path.join(os.path.dirname(path), p) for n, p in found.items()}


def register(spark: SparkSession, sources: dict[str, str]) -> None:
    for name, path in sources.items():
        _read_kind(spark, path).createOrReplaceTempView(name)


def _read_kind(spark: SparkSession, path: str) -> DataFrame:
    clean = path[:-1] if path.endswith("*") and not path.endswith("/*") else path
    return READERS[extension(clean)](spark, path) if extension(clean) in READERS else read(spark, path)


_MODES = {"new": "errorifexists", "append": "append", "overwrite": "overwrite"}


def insert_into(df: DataFrame, path: str, mode: str = "new") -> DataFrame:
    """Write to x.jsonl, x.json, x.csv or x.parquet and return the rows written (RETURNING).

    mode: new (fails if the table is there), append or overwrite. The rows are made once, in the
    shared folder, so that what comes back is what was written and the query does not run again.
    """
    df = materialize(df)
    writer = df.write.mode(_MODES[mode])
    kind = extension(path)
    if kind in ("jsonl", "json", "ndjson"):
        writer.json(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"cannot write {path}")
    return df


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int) -> None:
    """A range-partitioned, sorted Parquet table: what a secondary index gives, by min-max skipping."""
    df.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def suggest_indexes(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, distinct (approximate), rows and ratio: which columns are selective enough to sort by."""
    from pyspark.sql import functions as F

    columns = columns or df.columns
    one = df.agg(F.count(F.lit(1)).alias("rows"), *[F.approx_count_distinct(c).alias(f"d_{c}") for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"d_{c}").alias("distinct")) for c in columns])).alias("e")
    return one.select("rows", each).select("e.column", "e.distinct", "rows", (F.col("e.distinct") / F.col("rows")).alias("ratio"))
