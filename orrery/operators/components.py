"""Connected components of a graph held as rows of links.

Alternating large-star and small-star steps shrink the links to stars around each component's smallest node in about
the logarithm of its size steps. A node's smallest neighbour comes from a grouped minimum (combined before the
shuffle), so a node with very many links costs no single task its whole neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut

MAX_STEPS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: a, b (a <> b). Large: every larger neighbour of a node is linked to its smallest neighbour (or itself).
    Small: the node and its smaller neighbours are."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        out = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        out = down.join(least, "a").select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of ``links`` (a, b: any ordered type) that is
    not its own root. Links of a node to itself are ignored; an empty table gives an empty result."""
    now = cut(links.select("a", "b").where("a <> b").distinct())
    for _ in range(MAX_STEPS):
        last = now
        now = cut(_star(_star(last, large=True), large=False))
        mark = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))]
        if now.agg(*mark).first() == last.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(*mark).first():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    raise RuntimeError("components did not settle")
