"""Connected components of an edge table, on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import cut


def _star(edges: DataFrame) -> DataFrame:
    """Each u of (u, v) with the least of itself and its neighbours, joined back to its edges."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component): the smallest node reachable, for the nodes of the edges (u, v); no loops need be left out.

    Alternating stars: each round hangs a node's larger neighbours, then its smaller ones, on the least of them.  The
    table never grows, a round's minima are combined before the shuffle, and rounds grow with the logarithm of the
    nodes.  Each round is kept in a checkpoint.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large)
        edges = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
