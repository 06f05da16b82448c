"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _settled(edges: DataFrame) -> bool:
    """Whether the distinct edges (u > v) are stars: no node has two targets, or is one and has one."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("node").agg(F.sum("up").alias("a"), F.sum("down").alias("b")).where("a > 1 OR (a > 0 AND b > 0)")
    return bad.agg(F.count("*")).first()[0] == 0


def _round(edges: DataFrame) -> DataFrame:
    """A large and a small star: each node's greater neighbours go to the least one, then each
    node's lesser neighbours and itself do. Edges are u > v before and after."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    down = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, temps: list[DataFrame], rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of every node that isn't its own root. edges: u, v.
    Each round is written to the shared folder, and goes with the next; the last is added to temps."""
    edges = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if _settled(edges):
            temps.append(edges)
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        old, edges = edges, materialise(_round(edges), "stars")
        discard(old)
    raise RuntimeError("components did not settle")
