"""Queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, lm_scoring, mixing, packing, pii, quality_rules, sharding, simhash, substring_dedup, token_counts
from .common import read_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(read_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules.score_quality(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", *quality_rules.BASE, "base_failed", "kept", "p_good")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.lm_scores(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 4).alias("mean_log_score"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_token_counts, op2_mixing, op3_substring_dedup, op4_packing, op5_quality_rules, op6_sharding, op7_exact_dedup, op8_lm_scoring, op9_simhash, op10_pii]
    return {f.__name__: f for f in found}


_OP2 = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) || ':0'), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows,
    [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source)) - 1) % 3 + 1]::DOUBLE AS w
  FROM sized GROUP BY source),
levels AS (
  SELECT *, 2.0 * source_size AS most, 2.0::DOUBLE * source_size / w AS ratio,
    row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / w, source IS NULL, source) AS k FROM sources),
tried AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ()) - coalesce(sum(2 * source_size) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM levels),
chosen AS (SELECT arg_min(level, k) AS level FROM tried WHERE level <= ratio),
targets AS (
  SELECT source, source_size, source_rows, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM chosen), 1e300) * w) AS target FROM sources),
due AS (
  SELECT s.*, t.source_size, t.source_rows, t.target, coalesce(t.target / nullif(t.source_size::DOUBLE, 0), 0) AS due
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
odds AS (
  SELECT *, floor(due)::BIGINT AS copies, target - floor(due)::BIGINT * source_size AS rest,
    (u / (1 - u)) / ((due - floor(due)) / (1 - (due - floor(due)))
      * greatest(0.5::DOUBLE, least(2.0::DOUBLE, sqrt((source_size::DOUBLE / source_rows::DOUBLE) / nullif(size, 0)::DOUBLE)))) AS q
  FROM due),
ranked AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM odds WHERE size > 0 AND due > floor(due)),
cuts AS (
  SELECT source, min(q) AS cut FROM ranked WHERE upto > rest GROUP BY source),
gaps AS (
  SELECT c.source, c.cut, any_value(r.rest) - coalesce(sum(CASE WHEN r.q < c.cut THEN r.size END), 0) AS gap
  FROM cuts c JOIN ranked r ON r.source IS NOT DISTINCT FROM c.source GROUP BY c.source, c.cut),
fill1 AS (
  SELECT r.source, arg_min(r.q, (abs(gap - r.size), r.q)) AS f1, arg_min(r.size, (abs(gap - r.size), r.q)) AS s1
  FROM ranked r JOIN gaps g ON r.source IS NOT DISTINCT FROM g.source WHERE r.q >= cut AND abs(gap - r.size) < abs(gap) GROUP BY r.source),
gaps2 AS (
  SELECT g.source, g.cut, f.f1, g.gap - coalesce(f.s1, 0) AS gap FROM gaps g LEFT JOIN fill1 f ON f.source IS NOT DISTINCT FROM g.source),
fill2 AS (
  SELECT r.source, arg_min(r.q, (abs(gap - r.size), r.q)) AS f2
  FROM ranked r JOIN gaps2 g ON r.source IS NOT DISTINCT FROM g.source
  WHERE r.q >= cut AND abs(gap - r.size) < abs(gap) AND r.q IS DISTINCT FROM f1 GROUP BY r.source)
SELECT o.doc_id, o.size::BIGINT AS size, o.source_size, o.target,
  (o.size * (o.copies + CASE WHEN o.due > floor(o.due) AND o.size > 0 AND (o.q < g.cut OR o.q = g.f1 OR o.q = f.f2) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM odds o LEFT JOIN gaps2 g ON o.source IS NOT DISTINCT FROM g.source LEFT JOIN fill2 f ON o.source IS NOT DISTINCT FROM f.source
"""

_OP7 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


_OP8 = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
tokens AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
pairs AS (SELECT *, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS u, lag(w) OVER (PARTITION BY doc_id ORDER BY i) IS NOT NULL AS follows FROM tokens),
all1 AS (SELECT w, count(*) AS c FROM tokens GROUP BY w), own1 AS (SELECT doc_id, w, count(*) AS c FROM tokens GROUP BY ALL),
all2 AS (SELECT u, w, count(*) AS c FROM pairs WHERE follows GROUP BY ALL), own2 AS (SELECT doc_id, u, w, count(*) AS c FROM pairs WHERE follows GROUP BY ALL),
n AS (SELECT count(*) AS n FROM tokens), size AS (SELECT doc_id, len(words) AS n_words FROM split),
counted AS (
  SELECT p.doc_id, p.follows, a1.c - o1.c AS c1, ac.c - oc.c AS context, a2.c - o2.c AS c2, greatest(n.n - s.n_words, 1) AS rest
  FROM pairs p JOIN size s USING (doc_id) CROSS JOIN n
  JOIN all1 a1 ON a1.w = p.w JOIN own1 o1 ON o1.doc_id = p.doc_id AND o1.w = p.w
  LEFT JOIN all1 ac ON ac.w = p.u LEFT JOIN own1 oc ON oc.doc_id = p.doc_id AND oc.w = p.u
  LEFT JOIN all2 a2 ON a2.u = p.u AND a2.w = p.w LEFT JOIN own2 o2 ON o2.doc_id = p.doc_id AND o2.u = p.u AND o2.w = p.w),
scored AS (
  SELECT doc_id, CASE WHEN c2 > 0 THEN ln(c2 / context)
    ELSE ln(CASE WHEN c1 > 0 THEN c1 ELSE 0.4::DOUBLE END / rest) + CASE WHEN follows THEN ln(0.4::DOUBLE) ELSE 0 END END AS score FROM counted)
SELECT s.doc_id, s.n_words::BIGINT AS n_words, round(coalesce(sum(score), 0), 4) AS log_score,
  round(sum(score) / any_value(s.n_words), 4) AS mean_log_score
FROM size s LEFT JOIN scored USING (doc_id) GROUP BY ALL
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": _OP2, "op7_exact_dedup": _OP7, "op8_lm_scoring": _OP8}
