"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.core import checkpointed


HUB = 100_000  # neighbours


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges(a, b): the smallest node it is joined with.

    Each round links every node to the smallest it sees, first among its larger, then among its smaller neighbours; the
    rounds grow with the logarithm of the longest chain, so `most_rounds` is out of reach. Minima are aggregated before the
    shuffle. Those of nodes with more than HUB neighbours, of which there are at most edges / HUB, are broadcast; the
    others are joined in a shuffle, where no node then has more rows than HUB.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(most_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hubs = not both.groupBy("u").count().where(F.col("count") > HUB).isEmpty()
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = _beside(both.where("v > u"), least, hubs).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _beside(large, least, hubs).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        now = checkpointed(small)
        was, mark = mark, _mark(now)
        if was == mark:
            stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stars.union(stars.select("component", "component").distinct())
    raise RuntimeError("the components did not settle")


def _beside(edges: DataFrame, least: DataFrame, hubs: bool) -> DataFrame:
    """edges with the minimum m of their u; `hubs`: there may be nodes with more than HUB rows."""
    if not hubs:
        return edges.join(least.select("u", "m"), "u")
    known = F.broadcast(least.where(F.col("n") > HUB).select("u", "m"))
    others = edges.join(known.select("u"), "u", "left_anti").join(least.where(F.col("n") <= HUB).select("u", "m"), "u")
    return edges.join(known, "u").unionByName(others)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(0xFFFFFFFF))).first())
