"""Connected components of a link table, by alternating stars.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): the
large-star and small-star steps re-hang every node below the smallest neighbour
until each component is one star.  Each step is a grouped minimum (combined
before the shuffle) and one equi-join whose large side Spark may split, so a node
with a third of all links is no single task's work.  Links never reach the driver;
only a row count and a checksum of each round do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _hang(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    if not large:
        both = both.where("v < u")
    low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    joined = both.join(low, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    hung = joined.select(F.col("v").alias("u"), F.col("low").alias("v"))
    return hung.union(low.select("u", F.col("low").alias("v"))).where("u <> v")


def connected_components(links: DataFrame, scope: Scratch, max_rounds: int = 60) -> DataFrame:
    """``links(u, v)`` of longs to ``(node, root)``: root is the smallest node.

    Every node of a link appears once, its root included.  Self-links and repeated
    links are harmless; an empty table gives an empty table; null ends are ignored.  The
    result reads a table of ``scope``.
    """
    edges = scope.write(links.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        check = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if check["n"] == 0 or (check["n"], check["s"]) == before:
            break
        before = (check["n"], check["s"])
        edges = scope.write(_hang(_hang(edges, True).distinct(), False).distinct(), "links", rows=2 * check["n"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
