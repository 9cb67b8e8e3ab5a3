"""Connected components of an edge table, as joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pinned


def _large_star(e: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the smallest node of u's neighbourhood."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Edges point down (u > v): u and its lower neighbours are linked to the lowest of them."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    down = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """``(node, root)`` for each node of ``edges`` (bigint columns ``a`` and ``b``); root is the smallest node reachable.

    Distributed union-find by alternating large and small stars: each round is two hash
    aggregations and two joins, the edge set never grows beyond its size, and the rounds grow
    with the logarithm of the longest path. Each round is written to the shared folder, so a lost
    executor costs one round at most; only a row count and a checksum come to the driver.
    Null ends and loops are ignored (a loop's node is its own root already and is not returned).
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    e = pinned(e.distinct(), name)
    seen = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        e = pinned(_small_star(_large_star(e)), name)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
