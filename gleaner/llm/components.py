"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.session import cut_lineage


def _nearest(pairs: DataFrame) -> DataFrame:
    """The smallest neighbour of each ``u``, written so that joins with it can split hot nodes."""
    return cut_lineage(pairs.groupBy("u").agg(F.min("v").alias("m")), "stars")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _nearest(both).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` point from the larger node to the smaller one."""
    low = _nearest(edges)
    moved = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(u, v))")).first()
    )


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges(u, v)``: the smallest node of its component.

    Every round is written to the shared folder. A round halves the height of the trees
    at least, so their number follows the logarithm of the longest chain.
    """
    start = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = cut_lineage(start.filter("u <> v").distinct(), "edges")
    seen = _digest(current)
    while True:
        current = cut_lineage(_small_star(_large_star(current)), "edges")
        now = _digest(current)
        if now == seen:
            break
        seen = now
    roots = current.select(F.col("v").alias("u"), "v").distinct()
    return current.union(roots).select(F.col("u").alias("node"), F.col("v").alias("root"))
