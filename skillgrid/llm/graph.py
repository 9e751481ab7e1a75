"""Connected components of links between numbered nodes, as DataFrame jobs (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillgrid.llm.scratch import cut, drop


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _hook(edges: DataFrame) -> DataFrame:
    """Large star: every greater neighbour of a node is linked to the node's least neighbour."""
    both = _both(edges)
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _flatten(edges: DataFrame) -> DataFrame:
    """Small star: a node and its lesser neighbours are linked to the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id that each linked node reaches. Nodes without links aren't listed; null
    ends, self-links and repeated links don't matter; no links give no rows.

    Alternates large and small stars until nothing moves. Group minima are pre-aggregated and the joins back
    are ones whose hot keys adaptive execution splits, so a node may have any number of links. Each round is
    cut to the shared folder, where the one before it then goes; only two numbers of it reach the driver."""
    a, b = F.col(a).cast("long"), F.col(b).cast("long")
    edges = cut(links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    size = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())
    was = size(edges)
    while was[0]:
        last, edges = edges, cut(_flatten(_hook(edges)))
        now = size(edges)
        drop(last)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
