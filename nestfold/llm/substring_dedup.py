"""Suffix-array dedup: a depth-limited radix sort finds every repeated window of bytes.

The suffixes that start with a window of `span` bytes are ordered by most-significant-digit
passes and only as deep as the window; groups that are equal to that depth are exactly the
repeated windows, and all but a group's first are removed.

The first digit of a window is content-defined: the gram of least hash in it (its anchor) and
where that stands. Equal windows have equal anchors, neighbouring windows mostly share one, so
the windows of one anchor travel as one run and the first pass orders runs instead of windows:

1. runs are sorted by the anchor's hash, then by a hash of all their bytes. Runs equal to an
   earlier one are repeats whole; runs whose anchor nobody else has are done;
2. where one anchor has different runs, the bytes of the first of each kind of run go on, and
   the windows in them are sorted by the anchor's place and then eight bytes a pass; groups of
   one drop out after each pass.

Documents stay in blocks; runs are made distinct within a block before they are shuffled. Texts
are written once and shuffled once: both steps that read them beside what buckets answer take
the same exchange, so they are one plan, with nothing written in between.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import ascending, blocks, bucket_edges, deltas, give_back, mix, pack, split, unpack
from .common import bound_batches, materialize, parts_for

SPAN = 100
BLOCK_BYTES = 4 << 20
#: Bytes of text whose runs meet in one bucket, on average.
BUCKET_BYTES = 32 << 20
_CHUNK = 1 << 17
_LOW = np.uint64((1 << 18) - 1)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = [np.uint64(int(x) | 1) for x in mix(np.arange(1000, 1012, dtype=np.uint64))]
#: Windows that one radix sort holds, unless one anchor has more.
_SORT = 500_000


def gram_size(span: int) -> int:
    """A power of two: at most 32, and at most a third of the span (1 for the shortest)."""
    g = 1
    while 2 * g <= min(32, span // 3):
        g *= 2
    return g


def gram_hashes(buf: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes that start at each position."""
    h, n, k = _TABLE[buf], 1, 0
    while n < gram:
        h = h[:-n] * _ODD[k] + h[n:]
        n, k = 2 * n, k + 1
    return mix(h)


def anchors(buf: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window start the position of its anchor, and for each position its gram's hash."""
    n, width = len(buf) - span + 1, span - gram + 1
    if n <= 0:
        return np.empty(0, np.int32), np.empty(0, np.uint64)
    at, grams = np.empty(n, np.int64 if n > 1 << 30 else np.int32), np.empty(len(buf) - gram + 1, np.uint64)
    for s in range(0, n, _CHUNK):
        e = min(n, s + _CHUNK)
        h = gram_hashes(buf[s : e + span - 1], gram)
        grams[s : s + len(h)] = h
        v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the leftmost
        w = 1
        while 2 * w <= width:
            v = np.minimum(v[:-w], v[w:])
            w *= 2
        if w < width:
            v = np.minimum(v[: e - s], v[width - w : width - w + e - s])
        at[s:e] = (v[: e - s] & _LOW).astype(np.int64) + s
    return at, grams


class Runs:
    """The runs of one block: consecutive windows of one document with one anchor.

    lo, hi: first and last window start. key: hash of the anchor. kind: hash of the run.
    """

    def __init__(self, texts: list[bytes], span: int):
        gram = gram_size(span)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.buf = np.frombuffer(b"".join(texts), np.uint8)
        at, grams = anchors(self.buf, span, gram)
        if not len(at):
            self.lo = self.hi = self.anchor = np.empty(0, np.int64)
            self.key = self.kind = np.empty(0, np.uint64)
            self.doc = np.empty(0, np.int64)
            return
        valid = np.zeros(len(self.buf) + 1, np.int8)
        full = self.lengths >= span
        valid[self.starts[full]] += 1
        np.subtract.at(valid, self.starts[full] + self.lengths[full] - span + 1, 1)
        valid = np.cumsum(valid, dtype=np.int8)[: len(at)].astype(bool)
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1])
        last = valid.copy()
        last[:-1] &= ~valid[1:] | (at[1:] != at[:-1])
        self.lo, self.hi = np.flatnonzero(new), np.flatnonzero(last)
        self.anchor = at[self.lo].astype(np.int64)
        self.key = mix(grams[self.anchor] ^ _ODD[7])  # anchors have small hashes; these are even again
        places = [*range(0, span - gram, gram), span - gram]
        kind = ((self.hi - self.lo) * (span + 1) + self.anchor - self.lo).astype(np.uint64)
        del at, valid, new, last
        for edge in (self.lo, self.hi):
            for p in places:
                kind = mix(kind * _ODD[6] + grams[edge + p])
        self.kind = kind
        self.doc = np.searchsorted(self.starts, self.lo, "right") - 1


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Where a row of sorted keys differs from the row before."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = False
    for k in keys:
        out[1:] |= k[1:] != k[:-1]
    return out


def repeated_windows(text: np.ndarray, start: np.ndarray, major: np.ndarray, place: np.ndarray, rank: np.ndarray, span: int) -> np.ndarray:
    """Indexes of the windows that equal one of smaller rank, by most-significant-digit passes.

    Window k is text[start[k] : start[k] + span]; windows of different (major, place) differ.
    """
    alive = np.arange(len(start))
    order = np.lexsort((place, major))
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(_first_of(major[order], place[order]))
    padded = np.append(text, np.zeros(8, np.uint8))
    eight = np.lib.stride_tricks.sliding_window_view(padded, 8)
    depth = 0
    while True:
        # Groups of one are alone to every greater depth.
        _, inverse, size = np.unique(group[alive], return_inverse=True, return_counts=True)
        stay = size[inverse] > 1
        alive, of = alive[stay], inverse[stay]
        if depth >= span or not len(alive):
            break
        digit = eight[start[alive] + depth].view(">u8").ravel().astype(np.uint64)
        if depth + 8 > span:
            digit >>= np.uint64(8 * (depth + 8 - span))
        order = np.lexsort((digit, of))
        group[alive[order]] = np.cumsum(_first_of(of[order], digit[order]))
        depth += 8
    if not len(alive):
        return alive
    order = np.lexsort((rank[alive], of))
    alive, of = alive[order], of[order]
    return alive[~_first_of(of)]


def _ranges(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions as ranges of consecutive ones: first and last of each."""
    if not len(positions):
        return positions, positions
    new = np.append(True, np.diff(positions) != 1)
    return positions[new], positions[np.append(new[1:], True)]


def _digests(texts: list[bytes], starts: np.ndarray, lo: np.ndarray, hi: np.ndarray, span: int) -> list[tuple[int, int, int, str]]:
    """(bytes, removed bytes, removed runs, hash of the rest) of each text; windows lo..hi are removed."""
    ends = starts + np.array([len(t) for t in texts], np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], hi[order]
    out = []
    first = np.searchsorted(lo, starts)
    until = np.searchsorted(lo, ends)
    for t, s, a, b in zip(texts, starts.tolist(), first.tolist(), until.tolist(), strict=True):
        kept, removed, spans, done = [], 0, 0, 0
        edge = -1  # end of the current removed run
        for x, y in zip((lo[a:b] - s).tolist(), (hi[a:b] - s + span).tolist(), strict=True):
            if x > edge:
                kept.append(t[max(edge, 0) : x])
                spans += 1
                edge = done = x
            if y > done:
                removed += y - done
                edge = done = y
        kept.append(t[max(edge, 0) :])
        out.append((len(t), removed, spans, hashlib.sha256(b"".join(kept)).hexdigest()))
    return out


_RESULT = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _result(ids: list, digests: list[tuple[int, int, int, str]]) -> list[pa.Array]:
    columns = list(zip(*digests, strict=True)) if digests else [[], [], [], []]
    return [pa.array(ids, pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())]


def substring_dedup(docs: DataFrame, span: int = SPAN, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    Each byte is removed that lies in a `span`-byte string which also starts earlier: in a row of
    smaller id, or earlier in the same row. Windows never cross rows; all are judged on the
    input. Ids are integers; a null id comes first, and rows of one id are ordered as they are
    met. A null text is empty: no bytes, the hash of nothing. Repeated rows are repeats of each
    other; an empty table gives an empty one; other columns are ignored.

    Runs are told apart by two 64-bit hashes, the windows sorted in pass 2 by their bytes.
    """
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).cast("binary").alias("_text"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, block_bytes):
            order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0))
            joined = b"".join(texts[k] for k in order)
            known = np.array([ids[k] is not None for k in order])
            numbers = np.array([np.iinfo(np.int64).min if ids[k] is None else ids[k] for k in order], np.int64)
            body = pack(numbers, known, np.array([len(texts[k]) for k in order], np.int64), np.frombuffer(joined, np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([len(joined)]), pa.array([body], pa.binary())], ["block", "n", "body"])

    table = materialize(slim.mapInArrow(gather, "block long, n long, body binary"))
    buckets = parts_for(table.agg(F.sum("n")).first()[0] or 0, bucket_bytes)

    def documents(body: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Texts of a block; their ids, the smallest number for null; which ids are not null."""
        ids, known, lengths, joined = unpack(body)
        raw, at = joined.tobytes(), np.cumsum(lengths)
        return [raw[b - n : b] for n, b in zip(lengths.tolist(), at.tolist(), strict=True)], ids, known

    def distinct(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
        """Runs in the order of their keys; which of them are the first of their kind in the block."""
        order = np.lexsort((runs.lo, runs.kind, runs.key))
        return order, _first_of(runs.key[order], runs.kind[order])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(*batch.columns, strict=True):
                texts, of, _ = documents(body.as_py())
                runs = Runs(texts, span)
                order, first = distinct(runs)
                mine = order[first]
                key = runs.key[mine]
                kind, doc = runs.kind[mine], of[runs.doc[mine]]
                del texts, runs, order, first, mine
                found = [(b, pack(deltas(key[s:e]), kind[s:e], doc[s:e])) for b, s, e in split(key, buckets)]
                numbers_, blobs = [b for b, _ in found], [x for _, x in found]
                yield pa.RecordBatch.from_arrays([pa.array(numbers_, pa.int32()), pa.array([block.as_py()] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "block", "body"])
                give_back()

    def sort_runs(part: pd.DataFrame) -> pd.DataFrame:
        """States of each block's runs: 1 equals an earlier one, 2 first of its kind with an anchor of several kinds."""
        part = part.sort_values("block", ignore_index=True)
        got = [unpack(b) for b in part["body"]]
        sizes = [len(g[0]) for g in got]
        key = np.concatenate([ascending(g[0]) for g in got])
        kind = np.concatenate([g[1] for g in got])
        doc = np.concatenate([g[2] for g in got])
        del got
        order = np.lexsort((doc, kind, key))
        k, d = key[order], kind[order]
        new_key, new = _first_of(k), _first_of(k, d)
        state = np.where(new, 0, 1).astype(np.int8)
        if len(k):
            starts = np.flatnonzero(new_key)
            several = np.add.reduceat(new.astype(np.int64), starts) > 1
            state[new & np.repeat(several, np.diff(np.append(starts, len(k))))] = 2
        back = np.empty_like(state)
        back[order] = state
        del k, d, order, new, new_key, key, kind, doc
        out, at = [], 0
        for size in sizes:
            mine = back[at : at + size]
            where = np.flatnonzero(mine)
            out.append(pack(deltas(where.astype(np.int32)), mine[where]) if len(where) else None)
            at += size
        give_back()
        return pd.DataFrame({"block": part["block"], "bucket": part["bucket"], "body": out}).dropna()

    columns = "block long, bucket int, body binary"
    sorted_runs = table.select("block", "body").mapInArrow(explode, "bucket int, block long, body binary").groupBy("bucket").applyInPandas(sort_runs, columns)

    def judge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Rows to a bucket, with the bytes of runs, and one to -1 - block, with the windows that are removed by now."""
        block = int(left["block"].iat[0])
        texts, of, _ = documents(left["body"].iat[0])
        runs = Runs(texts, span)
        order, first = distinct(runs)
        mine = order[first]
        edges, state = bucket_edges(runs.key[mine], buckets), np.zeros(len(mine), np.int8)
        for bucket, body in zip(right["bucket"], right["body"], strict=True):
            where, what = unpack(body)
            state[edges[bucket] + ascending(where)] = what
        gone = np.sort(np.concatenate([order[~first], mine[state == 1]]))
        rows = []
        for b, s, e in split(runs.key[mine], buckets):
            some = mine[s:e][state[s:e] == 2]
            if len(some):
                lo, hi = runs.lo[some], runs.hi[some]
                size = hi - lo + span
                take = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
                rows.append((b, block, pack(runs.key[some], (runs.anchor[some] - lo).astype(np.int32), (hi - lo).astype(np.int32), of[runs.doc[some]], lo, runs.buf[take])))
        if len(gone):
            lo, hi = runs.lo[gone], runs.hi[gone]
            new = np.append(True, (lo[1:] != hi[:-1] + 1) | np.diff(runs.doc[gone]).astype(bool))
            rows.append((-1 - block, block, pack(lo[new], hi[np.append(new[1:], True)])))
        del runs, texts
        give_back()
        return pd.DataFrame(rows, columns=["to", "block", "body"])

    by_block = table.select("block", "body").groupBy("block")
    judged = by_block.cogroup(sorted_runs.groupBy("block")).applyInPandas(judge, "to long, block long, body binary")

    def sort_windows(part: pd.DataFrame) -> pd.DataFrame:
        if part["to"].iat[0] < 0:
            return part[["block", "body"]]
        part = part.sort_values("block", ignore_index=True)
        got = [unpack(b) for b in part["body"]]
        of_block = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        key, anchor, extent, doc, lo = (np.concatenate([g[k] for g in got]) for k in range(5))
        size = extent.astype(np.int64) + span
        start = np.cumsum(size) - size
        text = np.concatenate([g[5] for g in got])
        del got
        order = np.lexsort((lo, of_block, doc, key))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        windows = np.cumsum(extent[order].astype(np.int64) + 1)
        blocks_, found = [], []
        at = 0
        while at < len(order):  # anchors of about _SORT windows at a time
            goal = (windows[at - 1] if at else 0) + _SORT
            end = int(np.searchsorted(windows, goal)) + 1
            while end < len(order) and key[order[end]] == key[order[end - 1]]:
                end += 1
            some = order[at:end]
            n = extent[some].astype(np.int64) + 1
            run = np.repeat(some, n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            late = repeated_windows(text, start[run] + step, key[run], anchor[run] - step, rank[run] * (span + 1) + step, span)
            blocks_.append(of_block[run[late]])
            found.append(lo[run[late]] + step[late])
            at = end
        which, where = np.concatenate(blocks_), np.concatenate(found)
        order = np.lexsort((where, which))
        which, where = which[order], where[order]
        rows = []
        edges = np.searchsorted(which, np.arange(len(part) + 1))
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            if b > a:
                rows.append((int(part["block"].iat[k]), pack(*_ranges(where[a:b]))))
        return pd.DataFrame(rows, columns=["block", "body"])

    late = judged.groupBy("to").applyInPandas(sort_windows, "block long, body binary")

    def finish(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        texts, ids, known = documents(left["body"].iat[0])
        lengths = np.array([len(t) for t in texts], np.int64)
        removed = [unpack(b) for b in right["body"]]
        lo, hi = (np.concatenate([np.empty(0, np.int64), *(r[k] for r in removed)]) for k in range(2))
        out = pd.DataFrame(_digests(texts, np.cumsum(lengths) - lengths, lo, hi, span), columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        out.insert(0, "_id", pd.arrays.IntegerArray(ids, ~known))
        return out

    return by_block.cogroup(late.groupBy("block")).applyInPandas(finish, _RESULT).withColumnRenamed("_id", id_col)
