"""Exact dedup by deterministic block naming.

Texts are cut into fixed-size blocks; sorting the distinct blocks gives each an integer name.
Adjacent names are then paired and the distinct pairs sorted into names, until each document is
one name. Names are equal just where texts are, without trust in any hash, and depend on the
texts alone, not on how rows are dealt to tasks. A fingerprint (byte length and 64-bit hash) goes
before: a document whose fingerprint no other has differs from all others for certain, so only the
rest is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import join_groups, materialize, maybe_broadcast, parts_for

BLOCK_BYTES = 4096


def _fingerprinted(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), body.alias("_text"), F.octet_length(body).alias("_len"), F.xxhash64(body).alias("_h"))


def _split(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose fingerprint is unique; the others with a row number _rid, materialized."""
    printed = _fingerprinted(docs, text)
    shared = materialize(printed.select("_len", "_h").groupBy("_len", "_h").count().filter("count > 1").select("_len", "_h"))
    small = maybe_broadcast(shared, shared.count(), 40)
    alone = printed.join(small, ["_len", "_h"], "left_anti")
    others = printed.join(small, ["_len", "_h"], "left_semi").withColumn("_rid", F.monotonically_increasing_id())
    return alone, materialize(others)


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort materialized distinct keys into integer names 0, 1, ...; the order is that of a hash, then of the keys.

    A piece is a range of hashes, so that pieces are even and no keys, which are whole blocks,
    are sampled to the driver; counts of pieces give each piece its first name.
    """
    pieces = min(1 << 16, parts_for(distinct.count(), 100_000))
    dealt = distinct.withColumn("_h", F.xxhash64(*keys))
    dealt = dealt.withColumn("_piece", F.shiftright(F.shiftrightunsigned("_h", 48) * pieces, 16))
    counts = dealt.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # over pieces, not keys
    starts = counts.select("_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_piece").orderBy(F.shiftrightunsigned("_h", 1), "_h", *keys)) - 1
    named = dealt.withColumn("_place", place).join(F.broadcast(starts), "_piece")
    return materialize(named.withColumn("_name", F.col("_start") + F.col("_place")).drop("_h", "_piece", "_place", "_start"))


def block_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """_rid, _level and _name of a materialized table (_rid, _text); (_level, _name) is the identity.

    A round pairs names of one level; documents of one name leave it. Blocks and pairs are made
    distinct before they are shuffled, so a group of copies adds a row a task to any name, and
    names of very frequent ones are sent to their rows.
    """
    body = F.col("_text").cast("binary")
    n = F.greatest(F.ceil(F.octet_length("_text") / block_bytes), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(body, k * block_bytes + 1, F.lit(block_bytes)))
    blocks = texts.select("_rid", n.alias("_n"), F.posexplode(cut).alias("_i", "_block"))
    counted = materialize(blocks.groupBy("_block").agg(F.count(F.lit(1)).alias("_m")))
    names = _named(counted, ["_block"])
    size = counted.agg(F.sum("_m")).first()[0] or 0
    now = materialize(join_groups(blocks, names, ["_block"], "_m", size, block_bytes).select("_rid", "_n", "_i", "_name"))
    longest = texts.agg(F.max(n)).first()[0] or 1
    done, level = [], 0
    while True:
        done.append(now.filter("_n = 1").select("_rid", F.lit(level).alias("_level"), "_name"))
        if longest <= 1:
            break
        left, right = F.when(F.col("_i") % 2 == 0, F.col("_name")), F.when(F.col("_i") % 2 == 1, F.col("_name"))
        pairs = now.filter("_n > 1").groupBy("_rid", "_n", (F.col("_i") / 2).cast("int").alias("_p"))
        pairs = pairs.agg(F.max(left).alias("_a"), F.coalesce(F.max(right), F.lit(-1)).alias("_b"))
        pairs = materialize(pairs)
        names = _named(materialize(pairs.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_m"))), ["_a", "_b"])
        now = materialize(join_groups(pairs, names, ["_a", "_b"], "_m", pairs.count()).select("_rid", F.ceil(F.col("_n") / 2).cast("int").alias("_n"), F.col("_p").alias("_i"), "_name"))
        longest, level = -(-longest // 2), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _grouped(others: DataFrame, id_col: str, block_bytes: int) -> DataFrame:
    """_rid, _id, keep_id, group_size and kept of rows whose fingerprint is shared."""
    named = others.select("_rid", F.col(f"_row.{id_col}").alias("_id")).join(block_names(others.select("_rid", "_text"), block_bytes), "_rid")
    named = materialize(named)
    best = named.groupBy("_level", "_name").agg(F.max(F.struct("_id", "_rid")).alias("_best"), F.count(F.lit(1)).alias("group_size"))
    best = materialize(best)
    joined = join_groups(named, best, ["_level", "_name"], "group_size", named.count(), 60, best.count())
    return joined.select("_rid", "_id", F.col("_best._id").alias("keep_id"), "group_size", (F.col("_rid") == F.col("_best._rid")).alias("kept"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """id_col, keep_id, group_size, kept and text_sha256 of every row.

    Of rows with equal texts the one with the largest id stays; a null id is smallest, and of
    rows that share the largest id one stays. A null text equals an empty one. An empty table
    gives an empty one; other columns are ignored, whatever their names.
    """
    slim = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t"))
    alone, others = _split(slim, "_t")
    sha = F.sha2(F.col("_text").cast("binary"), 256).alias("text_sha256")
    single = alone.select(F.col("_row._id").alias(id_col), F.col("_row._id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    groups = materialize(_grouped(others, "_id", block_bytes))
    shared = others.select("_rid", sha).join(groups, "_rid")
    return single.unionByName(shared.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", "text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs` that `exact_groups` keeps, with all their columns."""
    alone, others = _split(docs, text)
    kept = materialize(_grouped(others, id_col, block_bytes).filter("kept").select("_rid"))
    stay = others.join(maybe_broadcast(kept, kept.count(), 24), "_rid", "left_semi")
    return alone.select("_row.*").unionByName(stay.select("_row.*"))
