"""Numpy arrays as compact bytes, and blocks of documents as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

_PLAIN = zstandard.ZstdCompressor(level=1)


_HEAD = struct.Struct("<3sII")  # type, length, bytes of the body
_RAW = 0xFFFFFFFF  # a body that does not compress stands as it is, so that small blobs stay small


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: each split into planes of equal significance, which compress well."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        raw = a.view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes()
        body = _PLAIN.compress(raw) if len(raw) > 32 else raw
        small = len(body) < len(raw)
        out += _HEAD.pack(a.dtype.str.encode(), len(a), len(body) if small else _RAW), body if small else raw
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        code, n, m = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        dtype = np.dtype(code.decode())
        if m == _RAW:
            m = n * dtype.itemsize
            raw = blob[at : at + m]
        else:
            raw = zstandard.ZstdDecompressor().decompress(blob[at : at + m])
        planes = np.frombuffer(raw, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel() if n else np.empty(0, dtype))
        at += m
    return out


def deltas(ascending: np.ndarray) -> np.ndarray:
    return np.diff(ascending, prepend=ascending.dtype.type(0))


def ascending(differences: np.ndarray) -> np.ndarray:
    return np.cumsum(differences, dtype=differences.dtype)


def blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[tuple[int, list, list[bytes]]]:
    """(block, ids, texts) of the rows (id, text as bytes) of a task, each block of about most_bytes.

    Block numbers are unique in one job. Null texts are empty.
    """
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 32
    ids, texts, held = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(i.as_py())
            texts.append(t.as_py() or b"")
            held += len(texts[-1]) + 16
            if held >= most_bytes:
                yield block, ids, texts
                block, ids, texts, held = block + 1, [], [], 0
    if ids:
        yield block, ids, texts


def split(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the buckets that hold any of the ascending 64-bit keys.

    Buckets without keys are left out, so what blocks send has at most as many blobs as keys,
    however many buckets the data make.
    """
    edges = bucket_edges(keys, buckets)
    for k in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield k, int(edges[k]), int(edges[k + 1])


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of ascending 64-bit keys begins, and the end."""
    bounds = np.array([(k << 64) // buckets for k in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, bounds), len(keys))


_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads any difference over all bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Return freed memory to the system; a Python worker lives on between tasks and would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only in the GNU C library
    if trim:
        trim(0)
