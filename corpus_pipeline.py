"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a
DataFrame; all but the last return the columns of `docs`. Stages are written as Parquet and read
again by the next one. Null texts count as empty (the quality stage rejects them); repeated rows and
null ids pass through as the operators' docstrings say; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nestfold.llm.common import materialize, read_table
from nestfold.llm.exact_dedup import exact_dedup
from nestfold.llm.mixing import mix
from nestfold.llm.packing import pack_documents
from nestfold.llm.quality_rules import quality_filter
from nestfold.llm.queries import VOCABULARY
from nestfold.llm.simhash import near_dedup


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a base rule or are probably bad go."""
    return quality_filter(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the one with the least id stays."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for: not at all, once or twice."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of each document in a training sequence of at most 1024 tokens."""
    return pack_documents(docs, VOCABULARY)


STAGES = [
    ("quality_rules", filter_quality),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: EM, near-duplicate search and the genetic algorithm have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
