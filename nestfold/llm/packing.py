"""Best-fit packing by a grouping genetic algorithm on islands.

Documents are tokenised and cut only if they are longer than a sequence. Pieces are dealt into
blocks of bounded size. Each block is packed by several islands: an individual is a whole packing
(a set of bins), crossover injects the well-filled bins of one parent into the other, removes
the documents that are then there twice, lets displaced ones take the place of smaller ones where
they fill a bin better, and fits the rest best-fit; between epochs the islands of a block send each
other their elite. Bins that stay poorly filled are opened again and their documents packed
together across blocks.
"""

from __future__ import annotations

import io
import json
import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize, parts_for

CAPACITY = 1024
#: Pieces in one block: what one task packs at once.
BLOCK = 8192
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3, 3, 5, 6
#: The rule by which the tokenizer splits a text before it merges bytes, with possessive runs.
_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_ENCODINGS: dict = {}


def encoding(path: str):
    """The tokenizer of a byte-level BPE file; built once in each process."""
    if path not in _ENCODINGS:
        import tiktoken

        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        moved = [b for b in range(256) if b not in kept]
        of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        ranks = {bytes(of[c] for c in p): k for p, k in data["model"]["vocab"].items() if p not in special}
        _ENCODINGS[path] = tiktoken.Encoding(path, pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODINGS[path]


def token_ids(path: str, text: str | None, end: int) -> np.ndarray:
    """Ids of a whole text and the end id, as little-endian unsigned 32-bit numbers."""
    ids = encoding(path).encode_to_numpy(text, allowed_special="all") if text else np.empty(0, np.uint32)
    return np.append(ids.astype("<u4", copy=False), np.uint32(end)).astype("<u4", copy=False)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: whole pieces of `capacity`, a shorter one first."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    return ([(0, head)] if head else []) + [(s, capacity) for s in range(head, n, capacity)]


def pieces(docs: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, piece, start, length and ids_crc32 of every piece of every row; one pass, no shuffle."""
    bound_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, t in enumerate(batch.column(1)):
                ids = token_ids(path, t.as_py(), end)
                raw = ids.tobytes()
                for p, (s, n) in enumerate(cut(len(ids), capacity)):
                    row.append(k)
                    piece.append(p)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
            columns = [batch.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "piece", "start", "length", "ids_crc32"])

    schema = slim.drop("_text").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return slim.mapInArrow(run, schema)


class Packer:
    """Packings of fixed items. A packing is a list of bins, a bin a list of item numbers."""

    def __init__(self, sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity

    def best_fit(self, items: list[int], bins: list[list[int]]) -> list[list[int]]:
        """Put each item, in the given order, where it leaves least room; opens bins as needed."""
        sizes, capacity = self.sizes, self.capacity
        by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        mask = 0  # bit r: some bin has room r
        for k, b in enumerate(bins):
            room = capacity - sum(map(sizes.__getitem__, b))
            if room:
                by_room[room].append(k)
                mask |= 1 << room
        for item in items:
            size = sizes[item]
            high = mask >> size
            if high:
                room = size + (high & -high).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
                bins[k].append(item)
                room -= size
            else:
                k, room = len(bins), capacity - size
                bins.append([item])
            if room:
                by_room[room].append(k)
                mask |= 1 << room
        return bins

    def fitness(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then bins filled unevenly: full ones beside ones that can be emptied."""
        return -len(bins), sum(sum(map(self.sizes.__getitem__, b)) ** 2 for b in bins)

    def decreasing(self, rng: random.Random | None = None) -> list[list[int]]:
        """Best fit decreasing; with `rng`, of sizes disturbed a little."""
        noise = (lambda k: self.sizes[k] * (1 + rng.uniform(-0.1, 0.1))) if rng else self.sizes.__getitem__
        return self.best_fit(sorted(range(len(self.sizes)), key=noise, reverse=True), [])

    def cross(self, into: list[list[int]], out_of: list[list[int]], rng: random.Random) -> list[list[int]]:
        """Inject well-filled bins of one parent, drop the bins they clash with, refit what is displaced."""
        full = [b for b in out_of if sum(map(self.sizes.__getitem__, b)) >= self.capacity - 1]
        chosen = [b for b in (full or out_of) if rng.random() < 0.5]
        taken = {i for b in chosen for i in b}
        kept, displaced = [], []
        for b in into:
            if taken.isdisjoint(b):
                kept.append(b)
            else:
                displaced += [i for i in b if i not in taken]
        kept = self._open_worst(kept, displaced, rng)
        kept = [list(b) for b in kept]
        displaced = self.replace(kept, displaced)
        return self.best_fit(displaced, [list(b) for b in chosen] + kept)

    def replace(self, bins: list[list[int]], displaced: list[int]) -> list[int]:
        """Let displaced items take the place of one or two smaller ones where a bin is fuller then.

        What is displaced in the end, largest first: as much in number or more, but easier to place.
        """
        sizes, out = self.sizes, sorted((self.sizes[i], i) for i in displaced)
        for b in bins:
            room = self.capacity - sum(map(sizes.__getitem__, b))
            if not room or not out:
                continue
            gain, best = 0, None
            groups = [(i,) for i in b]
            if len(b) <= 12:
                groups += [(i, j) for k, i in enumerate(b) for j in b[:k]]
            for group in groups:
                size = sum(map(sizes.__getitem__, group))
                k = bisect_right(out, (size + room, len(sizes))) - 1
                if k >= 0 and out[k][0] - size > gain:
                    gain, best = out[k][0] - size, (group, k)
            if best:
                group, k = best
                b.append(out.pop(k)[1])
                for i in group:
                    b.remove(i)
                    insort(out, (sizes[i], i))
        return [i for _, i in reversed(out)]

    def _open_worst(self, bins: list[list[int]], displaced: list[int], rng: random.Random) -> list[list[int]]:
        """Mutation: the least filled bins, and a few at random, are opened too."""
        fill = [sum(map(self.sizes.__getitem__, b)) for b in bins]
        edge = sorted(fill)[min(len(fill) - 1, len(fill) // 50)] if fill else 0
        kept = []
        for b, f in zip(bins, fill, strict=True):
            if f < self.capacity and (f <= edge or rng.random() < 0.02):
                displaced += b
            else:
                kept.append(b)
        return kept

    def bound(self) -> int:
        return -(-sum(self.sizes) // self.capacity)

    def evolve(self, elites: list[list[list[int]]], seed: int, generations: int, population: int) -> list[list[int]]:
        """Best packing after some generations that start from `elites`; stops at the lower bound."""
        rng = random.Random(seed)
        people = list(elites) or [self.decreasing()]
        best = max(people, key=self.fitness)
        if len(best) <= self.bound():
            return best
        while len(people) < population:
            people.append(self.decreasing(rng))
        population = max(2, population)
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(people)), reverse=True)
        for g in range(generations):
            if len(ranked[0][2]) <= self.bound():
                break
            a, b = (min(rng.sample(range(len(ranked)), 2)) for _ in range(2))  # tournaments of two
            if a == b:
                b = (a + 1) % len(ranked)
            born = [self.cross(ranked[x][2], ranked[y][2], rng) for x, y in ((a, b), (b, a))]
            seen, ranked = set(), sorted([*ranked, *((self.fitness(p), population + 2 * g + k, p) for k, p in enumerate(born))], reverse=True)
            # Packings of one fitness are mostly one packing: the population keeps apart what differs.
            ranked = [r for r in ranked if not (r[0] in seen or seen.add(r[0]))][:population]
            if len(ranked) < 2:
                p = self.decreasing(rng)
                ranked.append((self.fitness(p), -1 - g, p))
        return ranked[0][2]


def _bins(numbers) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for item, k in enumerate(numbers):
        out.setdefault(int(k), []).append(item)
    return list(out.values())


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for k, b in enumerate(bins):
        out[b] = k
    return out


def _order(part: pd.DataFrame) -> pd.DataFrame:
    """One order of a block's items, whatever order they came in; rows that agree are alike."""
    return part.sort_values(["length", "ids_crc32", "piece", "start", "_id"], ignore_index=True, kind="stable")


_STATE = "_block long, _island int, _from int, sizes binary, elite binary"


def _epoch(state: DataFrame, capacity: int, epoch: int, generations: int, population: int) -> DataFrame:
    """Each island of each block evolves what it has. An island is its items' sizes and one bin number each."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_from", ignore_index=True)
        block, island = int(part["_block"].iat[0]), int(part["_island"].iat[0])
        sizes = np.frombuffer(part["sizes"].iat[0], np.int32).tolist()
        elites = [_bins(np.frombuffer(e, np.int32)) for e in part["elite"] if e is not None]
        best = Packer(sizes, capacity).evolve(elites, hash((block, island, epoch)), generations, population)
        return part.iloc[:1].assign(_from=island, elite=_numbers(best, len(sizes)).tobytes())

    return state.groupBy("_block", "_island").applyInPandas(run, _STATE)


def pack(items: DataFrame, n: int, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, population: int = POPULATION, salt: int = 0) -> DataFrame:
    """Items with _block, _bin, _fill and _offset. Items: _id, piece, start, length, ids_crc32; n is their number.

    A block's items stand in one row, and islands have only sizes and bin numbers, so epochs and
    migrations move eight bytes an item. Items of a block are ordered by their values, so a lost
    task can be run again; equal rows may trade places freely.
    """
    key = F.xxhash64("_id", "piece", "start", "length", "ids_crc32", F.lit(salt))
    dealt = items.withColumn("_block", F.pmod(key, F.lit(parts_for(n, block))))
    names = items.columns

    def gather(part: pd.DataFrame) -> pd.DataFrame:
        ordered, sink = _order(part), io.BytesIO()
        table = pa.Table.from_pandas(ordered[names], preserve_index=False)
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return pd.DataFrame({"_block": ordered["_block"].iloc[:1], "sizes": [ordered["length"].to_numpy(np.int32).tobytes()], "body": [sink.getvalue()]})

    blocks = materialize(dealt.groupBy("_block").applyInPandas(gather, "_block long, sizes binary, body binary"))
    state = blocks.select("_block", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("_island"), F.lit(0).alias("_from"), "sizes", F.lit(None).cast("binary").alias("elite"))
    for epoch in range(epochs):
        state = materialize(_epoch(state, capacity, epoch, generations, population))
        if epoch < epochs - 1 and islands > 1:
            state = state.withColumn("_island", F.explode(F.array(F.col("_island"), (F.col("_island") + 1) % islands)))

    schema = items.schema
    for name in ("_block", "_bin", "_fill", "_offset"):
        schema = schema.add(name, "long")

    def choose(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        table = pa.ipc.open_stream(left["body"].iat[0]).read_all()
        length = table["length"].to_numpy()
        packer = Packer(length.tolist(), capacity)
        islands_ = right.sort_values("_island")["elite"]
        bins = np.frombuffer(max(islands_, key=lambda e: packer.fitness(_bins(np.frombuffer(e, np.int32)))), np.int32)
        fill = np.bincount(bins, weights=length).astype(np.int64)
        order = np.argsort(bins, kind="stable")
        upto = np.cumsum(length[order])
        first = np.append(True, np.diff(bins[order]) != 0)
        offset = np.empty(len(bins), np.int64)
        offset[order] = upto - length[order] - np.repeat((upto - length[order])[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
        out = {f.name: table[f.name].to_pandas() for f in table.schema} | {"_block": int(left["_block"].iat[0]), "_bin": bins.astype(np.int64), "_fill": fill[bins], "_offset": offset}
        return pd.DataFrame(out)[schema.names]

    return materialize(blocks.groupBy("_block").cogroup(state.groupBy("_block")).applyInPandas(choose, schema))


def pack_documents(docs: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY, id_col: str = "doc_id", text: str = "text", block: int = BLOCK, waste: float = 0.01) -> DataFrame:
    """id_col, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    A null text counts as empty: one piece that is the end id. Rows with null or repeated ids, and
    wholly repeated rows, are packed one by one; an empty table gives an empty one; other columns are
    ignored. Bins with more than `waste` of room are opened after the first packing and
    their items packed again across blocks; each block then loses at most its last bins.
    """
    items = materialize(pieces(docs, path, end, capacity, id_col, text))
    whole = items.filter(F.col("length") == capacity)
    # Whole pieces are sequences by themselves; a row number in the table makes theirs unique.
    out = whole.select("*", F.monotonically_increasing_id().alias("_n")).select(
        "_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("_n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest, kept = items.filter(F.col("length") < capacity), []
    for turn in range(2):
        n = rest.count()
        if not n:
            break
        packed = pack(rest, n, capacity, block, salt=turn)
        last = turn == 1 or n <= block
        good = packed if last else packed.filter(F.col("_fill") >= capacity * (1 - waste))
        number = F.col("_block") * (1 << 32) + F.col("_bin") * 2 + turn
        kept.append(good.select("_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), F.col("_offset").alias("offset")))
        if last:
            break
        rest = packed.filter(F.col("_fill") < capacity * (1 - waste)).select(*items.columns)
    for part in kept:
        out = out.unionByName(part)
    return out.withColumnRenamed("_id", id_col)
