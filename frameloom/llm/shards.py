"""Sharding by a tree of weighted hash draws."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import saved, unit

#: regions -> racks -> weights of their shards; shards are numbered in this order.
Tree = list[list[list[float]]]

SEED = 7


def even_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> Tree:
    return [[[1.0] * shards for _ in range(racks)] for _ in range(regions)]


def grown(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own: no other subtree's weight changes."""
    return [*tree, [[weight]]]


def _draw(children: Column, key: Column) -> Column:
    """The child whose exponential waiting time, of its weight as rate, is the shortest.

    A child's time depends on its own name, weight and the key, so a changed weight moves rows
    to or from that child only.
    """
    times = F.transform(children, lambda c: F.struct((-F.log(unit(F.lit(SEED), c.getField("name"), key)) / c.getField("weight")).alias("t"), c.getField("at").alias("at")))
    return F.array_min(times).getField("at")


def _level(parents: list[list[tuple[int, int, float]]]) -> Column:
    """A constant array: for each parent, its children of positive weight as (name, at, weight)."""
    def child(name, at, weight):
        return F.struct(F.lit(name).alias("name"), F.lit(at).alias("at"), F.lit(float(weight)).alias("weight"))
    return F.array(*[F.array(*[child(*c) for c in p if c[2] > 0]) for p in parents])


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that the key reaches from the root: a draw of the region, then rack, then shard.

    Names of nodes are their place in the tree, so adding children at an end renames nothing.
    """
    regions, racks, shards, n = [], [], [], 0
    for a, region in enumerate(tree):
        regions.append((1_000_000 + a, a, sum(map(sum, region))))
        own = []
        for b, rack in enumerate(region):
            own.append((2_000_000 + a * 1_000 + b, len(shards), sum(rack)))
            shards.append([((3_000 + a) * 1_000_000 + b * 1_000 + c, n + c, w) for c, w in enumerate(rack)])
            n += len(rack)
        racks.append(own)
    region = _draw(F.element_at(_level([regions]), 1), key)
    rack = _draw(F.element_at(_level(racks), region + 1), key)
    return _draw(F.element_at(_level(shards), rack + 1), key)


def assign(docs: DataFrame, tree: Tree | None = None, bucket_rows: int = 1 << 16) -> DataFrame:
    """One row per document with its shard and its place in it; law ``key``.

    Result: doc_id, size, text_crc32, law, shard, slot, grown_shard.  Size is the text's UTF-8
    bytes plus 8; null text counts as none.  doc_id and the tree decide the shard: equal doc_ids
    meet, a null doc_id is one more key, and one more shard takes rows only into itself.  Slots
    are gapless from 0 in each shard: rows are numbered inside hash buckets of about
    ``bucket_rows`` rows, and buckets start where the counts of those before end, so no task
    holds a shard.
    """
    tree = tree or even_tree()
    key = F.xxhash64("doc_id")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = docs.count()
    rows = saved(docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("_key"))
                 .select("*", shard_of(F.col("_key"), tree).alias("shard"), shard_of(F.col("_key"), grown(tree)).alias("grown_shard"),
                         F.pmod(F.xxhash64("_key", "text_crc32"), F.lit(n // (24 * bucket_rows) + 1)).cast("int").alias("_bucket")))
    counts = rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("shard", "_bucket").orderBy("_key", "text_crc32", "size")
    placed = rows.withColumn("_nth", F.row_number().over(inside) - 1).join(starts, ["shard", "_bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_nth")).alias("slot"), "grown_shard")
