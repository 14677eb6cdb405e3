"""SimHash near-dedup by May-Ozerov recursion.

A text's fingerprint has one bit for each of 192 random hyperplanes of its set of five-word
shingles, so texts of much common content have fingerprints of small Hamming distance. To find
close fingerprints without comparing all: a filter draws a strip of coordinates and a random
centre and lets through what is near the centre on the strip (a partial weight); close
fingerprints tend to pass together. How near, and whether a second filter on the next strip
follows, is chosen by the number of texts, so that lists stay small; lists are compared by brute
force, and there are as many filters as the target recall takes. A list that is long all the
same is cut into blocks, and a task compares two of them, so that no pair of a list is left out.
At 192 bits unlike texts are as close as near-duplicates by chance once in 8e12 pairs, so that
candidates do not run together however many texts there are.

What lists find are candidates. A candidate component's documents are compared exactly with its
leader, in blocks. Distance (1 - Jaccard) is a metric, so what is further than twice the limit
from the leader is further than the limit from all that the leader holds: such documents are
compared only with each other, the rest that the leader does not hold with the component, in
blocks. So classes are linked by exact similarity alone, and no group of copies becomes all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .blobs import mix
from .common import bound_batches, join_groups, materialize, maybe_broadcast, parts_for
from .components import components

WIDTH, SIMILARITY, RECALL = 5, 0.8, 0.999
BITS, STRIP = 192, 16
WORDS = BITS // 64
#: Random fingerprints that a list holds on average, at most; rows of a block of a longer list.
LIST, CHUNK = 8000, 16384
#: How far from its centre a filter lets pass, level by level; each plan's lists are shorter than the last one's.
PLANS = ((3,), (2,), (1,), (3, 3), (3, 2), (2, 2), (1, 2), (1, 1), (2, 2, 2))
#: Most trees (coordinate permutations), which bounds the passes over fingerprints.
TREES = 64
_STEP = [np.uint64(int(x) | 1) for x in mix(np.arange(77, 77 + 64, dtype=np.uint64))]
#: Sets of at most this many shingles are also linked by keys of their subsets.
FEW = 8
_ONES = np.array([bin(v).count("1") for v in range(1 << STRIP)], np.uint8)


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """Ascending distinct 64-bit hashes of a text's windows of `width` words.

    A text of fewer words has one shingle of all of them, one without words none.
    """
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    total = np.full(n, len(words) if len(words) < width else 0, np.uint64)
    for k in range(min(width, len(words))):
        total = total * _STEP[0] + h[k : k + n]
    return np.unique(mix(total))


def fingerprint(found: np.ndarray) -> list[int]:
    """Majority bits of the shingles' hashes as signed 64-bit numbers."""
    if not len(found):
        return [0] * WORDS
    planes = np.stack([mix(found ^ step) for step in _STEP[1 : 1 + WORDS]], 1)
    up = np.unpackbits(planes.view(np.uint8), axis=1).sum(0, dtype=np.uint16 if len(found) < 1 << 16 else np.int64).astype(np.int64) * 2 > len(found)
    return np.packbits(up).view(np.int64).tolist()


def subset_keys(found: np.ndarray, least: float) -> tuple[int | None, list[int]]:
    """Keys of few shingles: of all of them, and of all but one each.

    Sets that differ by one shingle of few are similar, but their majority bits differ more than
    those of large sets as similar; equal keys find them for certain.
    """
    n = len(found)
    if not 1 < n <= FEW:
        return None, []
    total = found.sum(dtype=np.uint64)
    whole = int(mix(total[None] ^ np.uint64(n)).view(np.int64)[0])
    parts = mix((total - found) ^ np.uint64(n - 1)).view(np.int64).tolist() if n - 1 >= least * n - 1e-9 else []
    return whole, parts


def bit_difference(similarity: float) -> float:
    """Chance that a bit differs between sets of equal size with this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def distances(similarity: float) -> np.ndarray:
    """Chance of each Hamming distance of such pairs."""
    d = bit_difference(similarity)
    return np.array([math.comb(BITS, k) * d**k * (1 - d) ** (BITS - k) for k in range(BITS + 1)])


def most_distance(similarity: float, recall: float = RECALL) -> int:
    """Hamming distance beyond which are at most half of the pairs that may be missed."""
    return int(np.flatnonzero(1 - np.cumsum(distances(similarity)) <= (1 - recall) / 2)[0])


def pass_chance(near: int) -> float:
    """Chance that a random fingerprint passes a filter."""
    return sum(math.comb(STRIP, k) for k in range(near + 1)) / 2**STRIP


def strip_chances(near: int) -> np.ndarray:
    """Chance that both of two fingerprints pass a random filter, by their distance on its strip."""
    out = np.zeros(STRIP + 1)
    for k in range(STRIP + 1):
        for u in range(k + 1):  # of the k bits that differ, u are unlike the centre in the first and k - u in the other
            out[k] += math.comb(k, u) * sum(math.comb(STRIP - k, v) for v in range(near - max(u, k - u) + 1))
    return out / 2**STRIP


def plan_for(n: int) -> tuple[int, ...]:
    """The first plan whose lists hold LIST of n random fingerprints or fewer."""
    return next((p for p in PLANS if n * math.prod(map(pass_chance, p)) <= LIST), PLANS[-1])


@cache
def filter_counts(near: tuple[int, ...], similarity: float, recall: float) -> tuple[int, int, tuple[int, ...]]:
    """Trees, centres a strip and later centres a strip, so that all levels together reach the recall.

    The miss chance is a mean over distances, of which those beyond the cutoff are missed, and
    over how a distance falls on the strips. Later centres are shared by the lists of a strip, and
    so count once a strip of a tree; fewer of them and more trees take fewest list entries.
    """
    if not 0 < recall < 1:
        raise ValueError("recall must be between 0 and 1")
    strips = BITS // STRIP
    weight = distances(similarity)[: most_distance(similarity, recall) + 1]
    rng = np.random.default_rng(1)
    falls = np.stack([rng.multivariate_hypergeometric([STRIP] * strips, k, size=2000) for k in range(len(weight))])
    after, later = np.ones(falls.shape), []
    for level, r in enumerate(near[1:], 1):
        both = strip_chances(r)[falls]
        later.append(math.ceil(0.3 / float(weight @ both.mean((1, 2)) / weight.sum())))
        after *= np.roll(1 - (1 - both) ** later[-1], -level, axis=2)
    both, best = strip_chances(near[0])[falls], None
    for centres in (2**k for k in range(16)):
        tree = (1 - (1 - (1 - both) ** centres) * after).prod(2).mean(1)
        missed = lambda trees, tree=tree: float(weight @ tree**trees + 1 - weight.sum())
        if missed(TREES) <= 1 - recall:
            trees = next(t for t in range(1, TREES + 1) if missed(t) <= 1 - recall)
            if best is None or trees * centres < best[0] * best[1]:
                best = trees, centres
    if best is None:
        raise ValueError(f"no filters of plan {near} reach a recall of {recall}")
    return *best, tuple(later)


def entries(near: tuple[int, ...], similarity: float = SIMILARITY, recall: float = RECALL) -> float:
    """List entries of a random fingerprint, on average."""
    trees, centres, later = filter_counts(near, similarity, recall)
    return trees * BITS // STRIP * centres * pass_chance(near[0]) * math.prod(c * pass_chance(r) for c, r in zip(later, near[1:], strict=True))


class Filters:
    """Filter paths: a strip and centre of a tree, then centres on that tree's following strips."""

    def __init__(self, near: tuple[int, ...], similarity: float, recall: float, seed: int = 7):
        self.strips, self.near = BITS // STRIP, near
        self.trees, self.centres, self.later = filter_counts(near, similarity, recall)
        rng = np.random.default_rng(seed)
        self.orders = [rng.permutation(BITS) for _ in range(self.trees)]
        self.first = rng.integers(0, 1 << STRIP, (self.trees, self.strips, self.centres), np.uint16)
        self.next = [rng.integers(0, 1 << STRIP, (self.trees, self.strips, c), np.uint16) for c in self.later]
        ball = np.flatnonzero(_ONES <= near[0]).astype(np.uint16)
        self.ball = (self.first[..., None] ^ ball).reshape(self.trees, self.strips, -1)
        order = np.argsort(self.ball, axis=2, kind="stable")
        self.of = (order // len(ball)).astype(np.uint16)
        self.ball = np.take_along_axis(self.ball, order, 2)

    def lists(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, list numbers) of fingerprints, an array of WORDS columns; a list number is a hash of the path."""
        bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1)
        for t, order in enumerate(self.orders):
            strips = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(np.uint16)
            for s in range(self.strips):
                values, ball = strips[:, s], self.ball[t, s]
                a = np.searchsorted(ball, values)
                n = np.searchsorted(ball, values, "right") - a
                row = np.repeat(np.arange(len(values)), n)
                centre = self.of[t, s, np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(row))]
                path = mix(((t * self.strips + s) * self.centres + centre.astype(np.uint64)) * _STEP[5] + np.uint64(1))
                for level, (centres, near) in enumerate(zip(self.next, self.near[1:], strict=True), 1):
                    at = (s + level) % self.strips
                    k, centre = np.nonzero(_ONES[strips[row, at, None] ^ centres[t, at]] <= near)
                    row, path = row[k], mix(path[k] * _STEP[6] + centre.astype(np.uint64))
                yield row, path


@cache
def filters_for(near: tuple[int, ...], similarity: float, recall: float) -> Filters:
    """The filters of a plan, built once in each process."""
    return Filters(near, similarity, recall)


def close_groups(prints: np.ndarray, most: int, cut: int = 0) -> np.ndarray:
    """For each fingerprint the first index of its group, groups linked by distances up to `most`.

    With a cut, only fingerprints before it are compared with those from it on.
    """
    n = len(prints)
    words = np.ascontiguousarray(prints.T).view(np.uint64)  # bits of a negative number are counted without its sign
    label = np.arange(n)
    for s in range(0, cut or n, 64):
        e, o = min(cut or n, s + 64), cut or s
        far = np.zeros((e - s, n - o), np.uint8)
        for w in words:
            far += np.bitwise_count(w[s:e, None] ^ w[None, o:])
        i, j = np.nonzero(far <= most)
        i, j = i + s, j + o
        later = j > i
        i, j = i[later], j[later]
        if not len(i):
            continue
        cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
        for a, b in zip(cuts, np.append(cuts[1:], len(i)), strict=True):
            own, other = label[i[a]], label[j[a:b]]
            if (other != own).any():
                group = np.unique(np.append(other, own))
                label[np.isin(label, group)] = group[0]
    return label


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b) or min(len(a), len(b)) < 0.01 * max(len(a), len(b)):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _links(queries: list[tuple[int, np.ndarray]], members: list[tuple[int, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links of similarity `least` or more between queries and members, of which a spanning forest is kept."""
    numbers = np.array([m for m, _ in members])
    sizes = np.array([len(s) for _, s in members])
    every = np.concatenate([s for _, s in members])
    owner = np.repeat(np.arange(len(members)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.get(x, x) != x:
            parent[x] = parent.get(parent[x], parent[x])
            x = parent[x]
        return x

    out = []
    for q, found in queries:
        a, b = np.searchsorted(every, found, "left"), np.searchsorted(every, found, "right")
        n = b - a
        hits = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(owner[hits], minlength=len(members))
        near = both >= least * (len(found) + sizes - both) - 1e-9
        for m in numbers[near & (numbers != q) & (both > 0)].tolist():
            x, y = root(q), root(m)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((q, m))
    return out


_PRINT = [f"_p{k}" for k in range(WORDS)]


def _printed(docs: DataFrame, id_col: str, text: str, width: int, least: float) -> DataFrame:
    """_id, _key (the text's SHA-256), _n (shingles), the fingerprint, _whole and _parts (`subset_keys`) of every row."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(body, 256)).alias("_key"), body.alias("_text"))
    schema = slim.drop("_text").schema.add("_n", "long")
    for name in _PRINT:
        schema = schema.add(name, "long")
    schema = schema.add("_whole", "long").add("_parts", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, whole, parts = [], [], []
            for t in batch.column(2):
                found = shingles(t.as_py(), width)
                rows.append((len(found), *fingerprint(found)))
                keys = subset_keys(found, least)
                whole.append(keys[0])
                parts.append(keys[1])
            new = [pa.array([r[k] for r in rows], pa.int64()) for k in range(1 + WORDS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *new, pa.array(whole, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], schema.names)

    return slim.mapInArrow(run, schema)


def candidates(reps: DataFrame, n: int, similarity: float, recall: float, near: tuple[int, ...] | None = None) -> DataFrame:
    """Edges (a, b) that connect what any list holds within the distance; a forest of stars a task.

    A list of more than CHUNK rows is dealt to g = rows / CHUNK blocks by a hash; each two blocks
    are a task and each row goes to g tasks, so that every pair of the list meets in one.
    """
    near, most = near or plan_for(n), most_distance(similarity, recall)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        filters = filters_for(near, similarity, recall)
        for batch in batches:
            for s in range(0, batch.num_rows, 2048):
                node = np.asarray(batch.column(0).slice(s, 2048))
                prints = np.stack([np.asarray(batch.column(1 + k).slice(s, 2048)) for k in range(WORDS)], 1)
                rows, found = zip(*filters.lists(prints), strict=True)
                row = np.concatenate(rows)
                yield np.concatenate(found), node[row], prints[row]

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, *_ in paths(batches):
            values, counts = np.unique(path.view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts, pa.int64())], ["list", "rows"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, node, prints in paths(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (path.view(np.int64), node, *prints.T)], ["list", "node", *_PRINT])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def found(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            task, upper, node, *prints = columns
            prints = np.stack(prints, 1)
            cuts = np.flatnonzero(np.append(True, task[1:] != task[:-1]))
            for s, e in zip(cuts, np.append(cuts[1:], len(task)), strict=True):
                m = int(np.searchsorted(upper[s:e], 1))
                if e - s < 2 or m == 0:
                    continue
                label = close_groups(prints[s:e], most, m if m < e - s else 0)
                far = np.flatnonzero(label != np.arange(e - s))
                if len(far):
                    yield pa.RecordBatch.from_arrays([pa.array(node[s:e][far]), pa.array(node[s:e][label[far]])], ["a", "b"])

        for batch in batches:
            held.append([np.asarray(c) for c in batch.columns])
            rows += batch.num_rows
            if rows < 2 * CHUNK:
                continue
            joined = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = int(np.flatnonzero(np.append(True, joined[0][1:] != joined[0][:-1]))[-1])  # the task that goes on
            yield from found([c[:last] for c in joined])
            held, rows = [[c[last:] for c in joined]], rows - last
        if rows:
            yield from found([np.concatenate(c) for c in zip(*held, strict=True)])

    prints = reps.select("_node", *_PRINT).repartition(parts_for(n, 8192))
    columns = ", ".join(f"{p} long" for p in _PRINT)
    dealt = prints.mapInArrow(deal, f"list long, node long, {columns}")
    long = prints.mapInArrow(lengths, "list long, rows long").groupBy("list").agg(F.sum("rows").alias("rows")).filter(F.col("rows") > CHUNK)
    long = materialize(long.select("list", F.ceil(F.col("rows") / CHUNK).cast("int").alias("g")))
    blocks = maybe_broadcast(long, long.count(), 24)
    dealt = dealt.join(blocks, "list", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    dealt = dealt.withColumn("y", F.pmod(F.xxhash64("list", "node"), F.col("g").cast("long")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    task = F.when(F.col("g") == 1, F.col("list")).otherwise(F.xxhash64("list", F.least("x", "y"), F.greatest("x", "y")))
    dealt = dealt.select(task.alias("task"), (F.col("y") > F.col("x")).cast("long").alias("upper"), "node", *_PRINT)
    return dealt.repartition("task").sortWithinPartitions("task", "upper").mapInArrow(compare, "a long, b long")


def subset_links(reps: DataFrame) -> DataFrame:
    """Links (a, b): a set of few shingles, and each set that has one more; and equal sets. A star a key."""
    whole = reps.filter(F.col("_whole").isNotNull()).groupBy(F.col("_whole").alias("_sub")).agg(F.min("_node").alias("b"))
    parts = reps.select(F.col("_node").alias("a"), F.explode("_parts").alias("_sub"))
    # Parts that no set equals are of no use; of equal sets each is linked to the first.
    same = reps.filter(F.col("_whole").isNotNull()).select(F.col("_node").alias("a"), F.col("_whole").alias("_sub"))
    every = materialize(parts.union(same))
    n = every.count()
    sizes = every.groupBy("_sub").agg(F.count(F.lit(1)).alias("_m"))
    if not n:
        return every.select("a", F.col("_sub").alias("b"))
    stars = join_groups(every, whole.join(sizes, "_sub"), ["_sub"], "_m", n)
    return stars.filter("a <> b").select("a", "b")


#: Sets that one task compares with a leader, or a block of queries with a block of members.
BLOCK = 2000


def _verified(docs: DataFrame, reps: DataFrame, cand: DataFrame, id_col: str, text: str, width: int, least: float) -> DataFrame:
    """Links (a, b) by exact similarity inside candidate components (node, label)."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(body, 256)).alias("_key"), body.alias("_text"))
    wanted = materialize(reps.join(cand, F.col("_node") == F.col("node")).select("_key", F.col("_id").alias("_rep"), "node", "label"))
    n = wanted.count()
    mine = texts.join(maybe_broadcast(wanted, n, 120), "_key").filter(F.col("_id").eqNullSafe(F.col("_rep")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], ["node", "label", "found"])

    held = materialize(mine.select("node", "label", "_text").mapInArrow(sets, "node long, label long, found binary"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = held.groupBy("label").agg(F.count(F.lit(1)).alias("m")).withColumn("g", F.ceil(F.col("m") / BLOCK).cast("int"))
    sizes = materialize(sizes)
    sized = join_groups(held, sizes, ["label"], "m", n, 24, sizes.count())
    leaders = held.filter("node = label").join(sizes, "label").select("label", every("g").alias("x"), F.col("found").alias("lead"))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [jaccard(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.float64())], ["node", "label", "near"])

    pairs = sized.filter("node <> label").select("node", "label", place("g").alias("x"), "found").join(leaders, ["label", "x"]).select("node", "label", "found", "lead")
    starred = materialize(pairs.mapInArrow(star, "node long, label long, near double"))
    out = starred.filter(F.col("near") >= least - 1e-12).select(F.col("node").alias("a"), F.col("label").alias("b"))
    # Further than twice the limit from the leader is further than the limit from all that it holds.
    far, lone = F.col("near") < least - 1e-12, F.col("near") < 2 * least - 1 - 1e-9
    total = lambda c: F.sum(c.cast("long"))
    open_ = starred.groupBy("label").agg((F.count(F.lit(1)) + 1).alias("m"), total(far).alias("u"), total(lone).alias("v"))
    open_ = materialize(open_.filter("u > 0 and m > 2"))
    kinds = starred.select("node", F.when(lone, 2).when(far, 1).otherwise(0).alias("kind"))
    rest = materialize(join_groups(held, open_, ["label"], "m", n, 40, open_.count()).join(kinds, "node", "left").withColumn("kind", F.coalesce("kind", F.lit(0))))
    # Round 0: those between (kind 1) against all. Round 1: the far ones (kind 2) against kinds 1 and 2.
    whole = rest.filter("u > v").select("*", F.lit(0).alias("round"), F.col("m").alias("all"), (F.col("u") - F.col("v")).alias("asked"), (F.col("kind") == 1).alias("far"))
    apart = rest.filter("kind > 0 and v > 0 and u > 1").select("*", F.lit(1).alias("round"), F.col("u").alias("all"), F.col("v").alias("asked"), (F.col("kind") == 2).alias("far"))
    rest = whole.unionByName(apart).withColumn("g", F.ceil(F.col("all") / BLOCK).cast("int")).withColumn("q", F.ceil(F.col("asked") / BLOCK).cast("int"))
    members = rest.select("*", place("g").alias("y"), F.lit(False).alias("asks")).withColumn("x", every("q"))
    queries = rest.filter("far").select("*", every("g").alias("y"), F.lit(True).alias("asks")).withColumn("x", place("q"))
    tasks = members.unionByName(queries)
    task = F.when((F.col("g") == 1) & (F.col("q") == 1), F.pmod(F.xxhash64("label"), F.lit(max(1, n // BLOCK)))).otherwise(F.xxhash64("label", "round", "x", "y"))

    def check(part: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, group in part.groupby(["label", "round", "x", "y"]):
            asks = group["asks"].to_numpy(bool)
            rows = [(int(k), np.frombuffer(f, np.uint64)) for k, f in zip(group["node"], group["found"], strict=True)]
            asking = list({k: (k, f) for (k, f), a in zip(rows, asks, strict=True) if a}.values())
            members = list({k: (k, f) for (k, f), a in zip(rows, asks, strict=True) if not a}.values())
            if asking and members:
                links += _links(asking, members, least)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    more = tasks.select(task.alias("task"), "label", "round", "x", "y", "node", "asks", "found").groupBy("task").applyInPandas(check, "a long, b long")
    return out.unionByName(more)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL, near: tuple[int, ...] | None = None) -> DataFrame:
    """id_col, class_id (the least id of the row's class) and _key (SHA-256 of the text) of every row.

    Two texts are linked if they are equal or the Jaccard similarity of their shingles is
    `similarity` or more; classes are what links connect. The chance to miss a pair that is just
    similar enough is about 1 - recall, and less the more similar it is or the more ways link
    it; sets of at most FEW shingles that differ by one are never missed. Texts without words are
    linked only to equal ones; null equals empty. A class without any id has a null class_id; null
    and repeated ids are rows like any. An empty table gives an empty one; other columns are
    ignored, whatever their names. `near` fixes the filters' plan; without it `plan_for` chooses.
    """
    bound_batches(docs.sparkSession)
    prints = materialize(_printed(docs, id_col, text, width, similarity))
    first = [F.first(c).alias(c) for c in ("_n", *_PRINT, "_whole", "_parts")]
    reps = prints.groupBy("_key").agg(F.min("_id").alias("_id"), F.count(F.lit(1)).alias("_copies"), *first)
    reps = materialize(reps.withColumn("_node", F.monotonically_increasing_id()))
    n = reps.count()
    found = candidates(reps.filter("_n > 0"), n, similarity, recall, near)
    links = _verified(docs, reps, components(found), id_col, text, width, similarity).unionByName(subset_links(reps))
    labels = materialize(components(links))
    labelled = reps.join(labels, F.col("_node") == F.col("node"), "left").select("_key", "_id", "_copies", F.coalesce("label", "_node").alias("_class"))
    labelled = materialize(labelled)
    named = materialize(labelled.groupBy("_class").agg(F.min("_id").alias("class_id"), F.count(F.lit(1)).alias("_m")))
    of_text = join_groups(labelled, named, ["_class"], "_m", n, 40).select("_key", "class_id", "_copies")
    rows = prints.select("_id", "_key")
    return join_groups(rows, of_text, ["_key"], "_copies", prints.count()).select(F.col("_id").alias(id_col), "class_id", "_key")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row of each class of `near_classes` with all columns: the one of least id.

    Of rows that share the least id, one of least text hash stays; a class of null ids likewise.
    """
    classes = materialize(near_classes(docs, id_col, text, width, similarity, recall))
    n = classes.count()
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.unhex(F.sha2(body, 256)).alias("_key"))
    first = classes.filter(F.col(id_col).eqNullSafe(F.col("class_id")))
    stay = first.groupBy("class_id").agg(F.min("_key").alias("_stay"), F.count(F.lit(1)).alias("_n"))
    sizes = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("_m"))
    stay = materialize(stay.join(sizes, stay["class_id"].eqNullSafe(sizes["class_id"])).select(stay["class_id"].alias("_c"), "_stay", "_n", "_m"))
    # What goes is far less than what stays, and so the side to send to the texts.
    other = ~(F.col(id_col).eqNullSafe(F.col("class_id")) & (F.col("_key") == F.col("_stay")))
    gone = join_groups(classes, stay.withColumnRenamed("_c", "class_id"), ["class_id"], "_m", n).filter(other)
    gone = materialize(gone.select(F.col(id_col).alias("_gone"), F.col("_key").alias("_gone_key")).distinct())
    small = maybe_broadcast(gone, gone.count(), 90)
    kept = rows.join(small, (F.col("_key") == F.col("_gone_key")) & F.col("_id").eqNullSafe(F.col("_gone")), "left_anti")
    same = materialize(stay.filter("_n > 1").select("_c", F.col("_stay").alias("_again")))
    n = same.count()
    if n:  # one of the rows that share id and text stays
        pair = (F.col("_key") == F.col("_again")) & F.col("_id").eqNullSafe(F.col("_c"))
        same = maybe_broadcast(same, n, 90)
        kept = kept.join(same, pair, "left_anti").unionByName(kept.join(same, pair, "left_semi").dropDuplicates(["_key", "_id"]))
    return kept.select("_row.*")
