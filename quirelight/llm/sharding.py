"""Sharding by a hierarchical weighted hash tree.

Shards hang in racks and racks in regions.  A row descends from the root; at
each node every child draws -ln(u) / weight, u being a hash of the row's key
and the child's name, and the least draw wins, so a child gets rows in
proportion to its weight and a change of one child's weight moves rows only
into or out of that child.  The first eight shards fill two regions of two
racks; each further shard opens a region of its own, so that growing by one
changes no weight inside an old region and takes rows only into the new one.

The law is ``key``: doc_id and the number of shards decide.

Defined results: null ids share the key ''; null texts have size 1 and
crc32 0; an empty table gives an empty result; repeated rows get the same
shard and slots of their own; extra columns are not read.  Slots are gapless
from 0 in each shard, in the order of a hash of the row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 8
SLOT_RANGES = 4096  # ranges of a shard's rows that are numbered apart


def layout(shards: int, weights: list[float] | None = None) -> dict:
    """{region: {rack: {shard: weight}}}"""
    weights = weights or [1.0] * shards
    tree: dict = {}
    for shard in range(shards):
        region, rack = (shard // 4, shard // 2) if shard < 8 else (shard - 6, shard - 4)
        tree.setdefault(region, {}).setdefault(rack, {})[shard] = weights[shard]
    return tree


def _weight(node: object) -> float:
    return sum(map(_weight, node.values())) if isinstance(node, dict) else float(node)


def _winner(key: Column, level: str, children: dict) -> Column:
    """The child with the least weighted draw, as an int column."""
    if len(children) == 1:
        return F.lit(next(iter(children)))
    draws = []
    for name, below in children.items():
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{level}{name}")).cast("binary")), 1, 13), 16, 10).cast("double")
        draws.append(F.struct((-F.log((bits + 0.5) / float(1 << 52)) / F.lit(_weight(below))).alias("draw"), F.lit(name).alias("name")))
    return F.array_min(F.array(*draws))["name"]


def shard_of(key: Column, tree: dict) -> Column:
    """The shard that ``key`` reaches; each level is one weighted draw."""

    def descend(level: int, children: dict) -> Column:
        if level == 2:
            return _winner(key, "shard", children)
        won = _winner(key, ("region", "rack")[level], children)
        out = None
        for name, below in children.items():
            there = descend(level + 1, below)
            out = F.when(won == name, there) if out is None else out.when(won == name, there)
        return out

    return descend(0, tree).cast("int")


def place(docs: DataFrame, shards: int = SHARDS, weights: list[float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    key = F.coalesce(docs[id_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shard_of(key, layout(shards, weights)).alias("shard"),
        shard_of(key, layout(shards + 1, [*weights, 1.0] if weights else None)).alias("grown_shard"),
    )
    rows = rows.withColumn("range", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(SLOT_RANGES)).cast("int"))
    # a fixed number of counts, whatever the input
    counts = rows.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(F.col("shard").alias("s"), F.col("range").alias("r"), (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("start"))
    numbered = rows.withColumn("nth", F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "text_crc32", "size")) - 1)
    found = numbered.join(starts, (F.col("shard") == F.col("s")) & (F.col("range") == F.col("r")), "left")
    return found.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("start") + F.col("nth")).cast("long").alias("slot"), "grown_shard")
