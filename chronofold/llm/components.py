"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _nearest(pairs: DataFrame) -> DataFrame:
    """For each node the smallest of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` has longs ``u`` and ``v``. Returns ``node``, ``root``: the smallest node reachable, for each node with an edge to another.

    A round moves each edge's ends towards the smallest neighbour: the number of rounds grows with the logarithm of the longest path.
    Neighbours of a node are never gathered in one task: the minima are aggregated (map-side first) and written, then joined with the
    edges as tables. A join of two tables, unlike one with an aggregate of the same shuffle, lets Spark split a node of very many edges.
    Each round's tables are deleted as soon as the next ones are there.
    """
    now = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = scratch.save(_nearest(both))
        large = scratch.save(both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        scratch.drop(near, now)
        low = scratch.save(_nearest(large))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = scratch.save(small.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        scratch.drop(large, low)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(seen)
