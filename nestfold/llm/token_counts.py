"""Token counts: greedy longest-match word pieces counted by a linear automaton.

A vocabulary has pieces that begin a word and pieces that continue one. `PieceCounter` keeps
both in one trie over bytes. Where a byte has no edge, the node's failure link names the node
that is reached after the longest piece (and whatever must follow it) is popped, and `popped`
says how many pieces that took; so every byte moves the automaton forward once and pieces are
never built. Matching is the longest-match-first rule of word-piece tokenizers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches

#: Words whose counts one Python worker remembers before it starts anew.
MEMO = 400_000


class PieceCounter:
    """Count the pieces of a word.

    first: pieces that begin a word. rest: pieces that continue one. Both are bytes.
    Every single byte is a piece too, so that a byte with which no other piece begins counts as one.
    """

    def __init__(self, first: set[bytes], rest: set[bytes]):
        self.edges: list[dict[int, int]] = [{}, {}]  # node 0 begins a word, node 1 continues it
        final = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for piece in sorted(pieces | {bytes([b]) for b in range(256)}):
                node = root
                for byte in piece:
                    nxt = self.edges[node].get(byte)
                    if nxt is None:
                        nxt = len(self.edges)
                        self.edges[node][byte] = nxt
                        self.edges.append({})
                        final.append(False)
                    node = nxt
                if piece:
                    final[node] = True
        self._link(final)

    def _link(self, final: list[bool]) -> None:
        """Failure links, breadth first; -1 at the two roots, where nothing is pending."""
        edges = self.edges
        fail, popped = [-1] * len(edges), [0] * len(edges)
        queue = [(child, 0, byte) for byte, child in edges[0].items()] + [(child, 1, byte) for byte, child in edges[1].items()]
        for node, parent, byte in queue:
            if final[node]:
                fail[node], popped[node] = 1, 1
            else:
                at, n = fail[parent], popped[parent]
                while at != -1 and byte not in edges[at]:
                    n += popped[at]
                    at = fail[at]
                if at != -1:
                    fail[node], popped[node] = edges[at][byte], n
            queue.extend((child, node, b) for b, child in edges[node].items())
        self.fail, self.popped = fail, popped

    def count(self, word: bytes) -> int:
        """Pieces of one word; 0 for an empty one."""
        edges, fail, popped = self.edges, self.fail, self.popped
        node = total = i = 0
        n = len(word)
        while i < n or node > 1:
            nxt = edges[node].get(word[i]) if i < n else None
            if nxt is not None:
                node = nxt
                i += 1
            else:
                total += popped[node]
                node = fail[node]
        return total


def byte_level_vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces of a byte-level vocabulary file: those after a blank begin words, the others continue them."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    pieces = {bytes(of[c] for c in piece) for piece in vocabulary if all(c in of for c in piece)}
    return {p[1:] for p in pieces if p[:1] == b" " and len(p) > 1}, {p for p in pieces if p[:1] != b" "}


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    """The automaton of a vocabulary file, built once in each process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(*byte_level_vocabulary(path))
    return _COUNTERS[path]


class _Memo(dict):
    def __init__(self, count):
        super().__init__()
        self.count = count

    def __missing__(self, word: bytes) -> int:
        n = self.count(word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n


def count_pieces(text: bytes | None, memo: _Memo) -> tuple[int, int, int]:
    """Words, pieces and the most pieces in a word of one text."""
    words = text.split() if text else []
    counts = list(map(memo.__getitem__, words))
    return len(words), sum(counts), max(counts, default=0)


def token_counts(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The `keep` columns with n_words, n_tokens and max_word_tokens (long) of each whole text.

    Words are runs of non-white-space bytes; a null or empty text has 0 of each. Rows are
    neither joined nor dropped, so repeated rows and null ids come out as they went in; an
    empty table gives an empty one. Columns of other names are ignored. One pass, no shuffle;
    a worker's memory is the automaton, a memo of at most MEMO words and one Arrow batch.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(counter(path).count)
        for batch in batches:
            found = [count_pieces(t.as_py(), memo) for t in batch.column(batch.num_columns - 1)]
            new = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names)

    names = [*keep, "n_words", "n_tokens", "max_word_tokens"]
    slim = docs.select(*keep, F.col(text).cast("binary").alias("_text"))
    schema = slim.drop("_text").schema
    for name in names[len(keep) :]:
        schema = schema.add(name, "long")
    return slim.mapInArrow(run, schema)
