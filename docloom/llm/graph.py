"""Connected components of a link table, by DataFrame rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest one the node knows."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.where("u is not null and v is not null and u != v").distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one link, to a centre."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")),
        F.struct(F.col("v").alias("node"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))).alias("e")).select("e.*")
    both = ends.groupBy("node").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v"))
    return both.where("as_u > 1 or (as_u > 0 and as_v > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v): one row (node, component) for each node, component its smallest node.

    Alternates large and small stars until only stars are left; links only ever shrink
    towards stars around the smallest node, so the number of rounds is logarithmic. Each round
    is written to the shared folder. Loops, repeated links and nulls are left out; an empty
    table gives an empty one.
    """
    now = saved(_tidy(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), "edges")
    while not _only_stars(now):
        now = saved(_tidy(_small_star(_large_star(now))), "edges")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
