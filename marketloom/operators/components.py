"""Connected components of an edge table by alternating star contraction.

Each round lets every node point its larger neighbours (large star) and then its smaller ones
(small star) at its smallest neighbour (Kiveris et al., 2014). The number of rounds grows with the
logarithm of the graph, not with its diameter. Minima are partial aggregates and the join back is
skew-splittable, so a node with very many edges is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    return both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    lowest = down.groupBy("a").agg(F.min("b").alias("low"))
    linked = down.join(lowest, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.union(lowest.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node. Rounds go on until nothing changes."""
    stars = cut_lineage(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a <> b").distinct())
    before = _fingerprint(stars)
    while True:
        stars = cut_lineage(_small_star(_large_star(stars)))
        after = _fingerprint(stars)
        if after == before:
            roots = stars.select(F.col("b").alias("node")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
                roots.select("node", F.col("node").alias("component")))
        before = after
