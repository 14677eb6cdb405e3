"""Stupid-backoff scores of all documents against each other, computed relationally.

Documents stand in blocks; a block's n-grams are exploded and counted within it, so that a
frequent n-gram is one row a block. Count tables partitioned by the n-gram's hash add the
blocks' counts up and are joined back to the blocks' n-grams; a block then sums the scores of
its documents. An n-gram's own document does not count for it, so a text is judged by the rest.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .blobs import ascending, blocks, bucket_edges, deltas, give_back, mix, pack, split, unpack
from .common import bound_batches, materialize, parts_for

BLOCK_BYTES = 8 << 20
#: Keys that one count table (one task) holds at most.
TABLE_KEYS = 2_500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts, words of each text, and the hash of each number's word."""
    numbers: dict[bytes, int] = defaultdict(count().__next__)
    parts, lengths = [], []
    for t in texts:
        words = t.split()
        lengths.append(len(words))
        parts.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, numbers), np.uint64, len(numbers))
    return np.concatenate(parts) if parts else np.empty(0, np.int32), np.array(lengths, np.int64), hashes


def _grams(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys of all n-grams up to `order`, ascending; for each n, the place of the n-gram that
    ends at each token (-1: it would begin before the text); the document of each token."""
    doc = np.repeat(np.arange(len(lengths)), lengths)
    nth = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    h = hashes[tokens] if len(tokens) else np.empty(0, np.uint64)
    keys, key = [], h
    for n in range(1, order + 1):
        if n > 1:
            before = np.empty_like(key)
            before[:1], before[1:] = 0, key[:-1]
            key = mix(before * _STEP + h + np.uint64(n))
        keys.append(key)
    valid = [nth >= n for n in range(order)]
    found, inverse = np.unique(np.concatenate([k[v] for k, v in zip(keys, valid, strict=True)]), return_inverse=True)
    places, at = [], 0
    for v in valid:
        m = int(v.sum())
        place = np.full(len(tokens), -1, np.int64)
        place[v] = inverse[at : at + m]
        places.append(place)
        at += m
    return found, places, doc


def _own_counts(place: np.ndarray, doc: np.ndarray, n_keys: int) -> np.ndarray:
    """How often the n-gram at each token stands in the token's own document."""
    out = np.zeros(len(place), np.int64)
    ok = place >= 0
    _, inverse, counts = np.unique(doc[ok] * n_keys + place[ok], return_inverse=True, return_counts=True)
    out[ok] = counts[inverse]
    return out


def score_block(tokens: np.ndarray, lengths: np.ndarray, hashes: np.ndarray, others: np.ndarray, total: int, order: int, backoff: float) -> np.ndarray:
    """Log score of each document. others: counts in other blocks of the keys of `_grams`."""
    found, places, doc = _grams(tokens, lengths, hashes, order)
    counts = others.copy()
    for place in places:
        counts += np.bincount(place[place >= 0], minlength=len(found))
    rest = np.maximum(total - lengths, 1)[doc]
    seen = []
    for place in places:
        c = np.where(place >= 0, counts[place] if len(found) else 0, 0) - _own_counts(place, doc, max(len(found), 1))
        seen.append(c)
    score = np.log(np.where(seen[0] > 0, seen[0], backoff) / rest)
    for n in range(1, order):
        context = np.empty_like(seen[n - 1])
        context[:1], context[1:] = 0, seen[n - 1][:-1]
        hit = seen[n] > 0
        longer = np.log(np.where(hit, seen[n], 1) / np.where(hit, context, 1))
        score = np.where(hit, longer, np.where(places[n] >= 0, np.log(backoff) + score, score))
    return np.bincount(doc, weights=score, minlength=len(lengths))


def lm_scores(docs: DataFrame, order: int = 2, backoff: float = 0.4, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, n_words, log_score (sum over the words) and mean_log_score of every row.

    The score of a word is count(n-gram) / count(its first n - 1 words), counted in all other
    rows; where the n-gram is not there, `backoff` times the score with one word less; a
    single word's is its count (or `backoff`, if no other row has it) over all words of the
    other rows. A null or empty text has 0 words, log_score 0 and mean_log_score null. Null and
    repeated ids are rows like any; an empty table gives an empty one; other columns are ignored.
    N-grams are told apart by 64-bit hashes. Counts are over all rows, without pruning.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text).cast("binary").alias("_text"))
    id_type = slim.schema["_id"].dataType
    encoded = StructType([StructField("block", LongType()), StructField("ids", ArrayType(id_type)), StructField("n", LongType()), StructField("body", BinaryType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def noted(source):
            nonlocal kind
            for batch in source:
                kind = batch.schema.field(0).type
                yield batch

        for block, ids, texts in blocks(noted(batches), block_bytes):
            tokens, lengths, hashes = _encode(texts)
            row = [pa.array([block]), pa.array([ids], pa.list_(kind)), pa.array([len(tokens)]), pa.array([pack(tokens, lengths, hashes)], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, encoded.names)

    table = materialize(slim.mapInArrow(encode, encoded))
    total = table.agg(F.sum("n")).first()[0] or 0
    buckets = parts_for(total * order, TABLE_KEYS)

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column(0), batch.column(1), strict=True):
                found, places, _ = _grams(*unpack(body.as_py()), order)
                counts = np.zeros(len(found), np.int64)
                for place in places:
                    counts += np.bincount(place[place >= 0], minlength=len(found))
                parts = [(b, pack(deltas(found[s:e]), counts[s:e].astype(np.int32))) for b, s, e in split(found, buckets)]
                numbers, blobs = [b for b, _ in parts], [x for _, x in parts]
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([block.as_py()] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "body"])
                del found, places, counts
                give_back()

    def join(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("block", ignore_index=True)
        got = [unpack(b) for b in part["body"]]
        sizes = [len(g[0]) for g in got]
        keys = np.concatenate([ascending(g[0]) for g in got])
        own = np.concatenate([g[1] for g in got]).astype(np.int64)
        del got
        order_ = np.argsort(keys, kind="stable")
        ranked = keys[order_]
        first = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, np.int64)
        sums = np.add.reduceat(own[order_], first) if len(first) else own
        more = np.empty_like(own)
        more[order_] = np.repeat(sums, np.diff(np.append(first, len(ranked))))
        more -= own
        out, at = [], 0
        for size in sizes:
            mine = more[at : at + size]
            where = np.flatnonzero(mine)
            out.append(pack(deltas(where.astype(np.int32)), mine[where]) if len(where) else None)
            at += size
        del keys, own, order_, ranked, more
        give_back()
        return pd.DataFrame({"block": part["block"], "bucket": part["bucket"], "more": out}).dropna()

    grams = table.select("block", "body").mapInArrow(explode, "bucket int, block long, body binary")
    joined = grams.groupBy("bucket").applyInPandas(join, "block long, bucket int, more binary")
    result = StructType([StructField("_id", id_type), StructField("n_words", LongType())]).add("log_score", "double").add("mean_log_score", "double")

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        tokens, lengths, hashes = unpack(left["body"].iat[0])
        found = _grams(tokens, lengths, hashes, order)[0]
        others, edges = np.zeros(len(found), np.int64), bucket_edges(found, buckets)
        for bucket, body in zip(right["bucket"], right["more"], strict=True):
            where, more = unpack(body)
            others[edges[bucket] + ascending(where)] = more
        score = score_block(tokens, lengths, hashes, others, total, order, backoff)
        ids = pd.Series(list(left["ids"].iat[0]), dtype=object)
        mean = pd.Series(score / np.maximum(lengths, 1)).where(lengths > 0, None)
        return pd.DataFrame({"_id": ids, "n_words": lengths, "log_score": score, "mean_log_score": mean})

    out = table.select("block", "ids", "body").groupBy("block").cogroup(joined.groupBy("block")).applyInPandas(finish, result)
    return out.withColumnRenamed("_id", id_col)
