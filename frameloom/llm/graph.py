"""Connected components of links, by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of the links (a, b) with the smallest node that it reaches.

    A round maps each node to its smallest neighbour, follows that map once more, and keeps the
    links between different images.  Minima are taken before rows are shuffled, and joins are
    plain, so a node of any number of links is split.  Rounds grow with the logarithm of the
    longest chain; each is written before the next.
    """
    edges = saved(links.select("a", "b").where("a <> b").distinct())
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = saved(both.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = saved(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        far = to.select(F.col("a").alias("to"), F.col("to").alias("further"))
        to = saved(to.join(far, "to", "left").select("a", F.coalesce("further", "to").alias("to")))
        named = saved(named.join(to.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        edges = edges.join(to, "a").select(F.col("to").alias("x"), "b")
        edges = edges.join(to.select(F.col("a").alias("b"), F.col("to").alias("y")), "b")
        edges = saved(edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return named
