"""Sharding by Karmarkar-Karp differencing: near-equal bytes with indivisible groups.

A group (all documents of one text) starts as a partial partition: its size in one shard, 0 in
the others. Again and again the two partial partitions of largest spread are combined, the
larger shards of one with the smaller shards of the other. Tasks difference their own groups;
what each leaves, one partial partition of very small spread, is differenced again one level
up, until one is left. So no task and no driver holds all groups.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, number_rows, parts_for

#: Partial partitions that one task differences.
FAN_IN = 50_000


def difference(rows: list[tuple[int, ...]], shards: int) -> list[list[int]]:
    """Combine partial partitions (tuples of shard sizes) into one.

    Returns, for each row, the shard that each of its parts went to. Deterministic: ties go
    by position. No rows give no lists.
    """
    if not rows:
        return []
    heap, nodes = [], []
    for k, row in enumerate(rows):
        order = sorted(range(shards), key=lambda s: (row[s], s))
        sizes = tuple(row[s] for s in order)
        nodes.append((order, None))  # a leaf: which of its parts stands at each place
        heap.append((sizes[0] - sizes[-1], k, sizes))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, x = heapq.heappop(heap)
        _, b, y = heapq.heappop(heap)
        both = [x[k] + y[shards - 1 - k] for k in range(shards)]
        order = sorted(range(shards), key=lambda s: (both[s], s))
        nodes.append((order, (a, b)))
        sizes = tuple(both[s] for s in order)
        heapq.heappush(heap, (sizes[0] - sizes[-1], len(nodes) - 1, sizes))
    out: list[list[int]] = [[]] * len(rows)
    todo = [(heap[0][1], list(range(shards)))]  # a node and the shard of each of its places
    while todo:
        node, to = todo.pop()
        order, parts = nodes[node]
        if parts is None:
            mine = [0] * shards
            for place, part in enumerate(order):
                mine[part] = to[place]
            out[node] = mine
            continue
        own = [0] * shards
        for place, k in enumerate(order):
            own[k] = to[place]
        a, b = parts
        todo.append((a, own))
        todo.append((b, own[::-1]))
    return out


def _level(nodes: DataFrame, shards: int) -> DataFrame:
    """Difference the nodes (_node, _task, _sizes) of each task: _node, _task, _to, _sizes (those of the result, on one row a task)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_node", ignore_index=True)
        rows = [tuple(map(int, r)) for r in part["_sizes"]]
        to = difference(rows, shards)
        total = [0] * shards
        for row, where in zip(rows, to, strict=True):
            for size, shard in zip(row, where, strict=True):
                total[shard] += size
        sizes = [total] + [None] * (len(rows) - 1)
        return pd.DataFrame({"_node": part["_node"], "_task": part["_task"], "_to": to, "_sizes": sizes})

    return nodes.groupBy("_task").applyInPandas(run, "_node long, _task long, _to array<int>, _sizes array<long>")


def _first_level(groups: DataFrame, tasks: int, shards: int) -> DataFrame:
    """As `_level`, for groups (_key, _bytes): each one's part 0 has its size."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_key", ignore_index=True)
        rows = [(int(b), *[0] * (shards - 1)) for b in part["_bytes"]]
        shard = [to[0] for to in difference(rows, shards)]
        total = [0] * shards
        for b, s in zip(part["_bytes"], shard, strict=True):
            total[s] += int(b)
        return pd.DataFrame({"_key": part["_key"], "_task": part["_task"], "_part": shard, "_sizes": [total] + [None] * (len(rows) - 1)})

    dealt = groups.withColumn("_task", F.pmod(F.xxhash64("_key"), F.lit(tasks)))
    return dealt.groupBy("_task").applyInPandas(run, "_key binary, _task long, _part int, _sizes array<long>")


def group_shards(groups: DataFrame, n_groups: int, shards: int = 8, fan_in: int = FAN_IN) -> DataFrame:
    """_key and shard of groups (_key, _bytes)."""
    tasks = parts_for(n_groups, fan_in)
    placed = materialize(_first_level(groups, tasks, shards))
    nodes = placed.filter("_sizes is not null").select(F.col("_task").alias("_node"), "_sizes")
    out = placed.select("_key", "_task", "_part")
    while tasks > 1:
        tasks = parts_for(tasks, fan_in)
        up = materialize(_level(nodes.withColumn("_task", F.pmod(F.xxhash64("_node"), F.lit(tasks))), shards))
        out = out.join(up.select(F.col("_node").alias("_task"), F.col("_task").alias("_up"), "_to"), "_task")
        out = out.select("_key", F.col("_up").alias("_task"), F.get(F.col("_to"), F.col("_part")).alias("_part"))
        nodes = up.filter("_sizes is not null").select(F.col("_task").alias("_node"), "_sizes")
    return out.select("_key", F.col("_part").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """id_col, size, text_crc32, law ("bytes"), shard, slot and grown_shard (null) of every row.

    Size is the text's bytes plus 1. Rows of equal texts (null equals empty) go to one shard
    together. Slots number a shard's rows gaplessly from 0. Null and repeated ids are placed as
    any; an empty table gives an empty one; other columns are ignored. Groups are summed before
    they are shuffled; texts never leave the scan.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.unhex(F.sha2(body, 256)).alias("_key"),
    )
    slim = materialize(slim)
    groups = materialize(slim.groupBy("_key").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_m")))
    to = group_shards(groups.drop("_m"), groups.count(), shards, fan_in).join(groups.select("_key", "_m"), "_key")
    placed = materialize(join_groups(slim, to, ["_key"], "_m", slim.count()).drop("_m"))
    numbered = number_rows(placed, ["shard"], ["_id", "_key"], "slot", placed.count())
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
