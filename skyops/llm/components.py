"""Connected components of a distributed edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyops.llm.common import stage


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the smallest node of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return (both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of these neighbours. Rows have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return (joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct())


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the smallest node of its component.

    Each round is written to the shared folder, so the plan stays short and a lost executor costs one round. The number of rounds
    grows with the logarithm of the longest path; more than ``max_rounds`` is an error, never a partial answer."""
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    files = 1 + now.count() // 250_000  # edges never grow in number
    for _ in range(max_rounds):
        now = stage(_small(_large(now)).coalesce(files), "edges")
        if _is_stars(now):
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    raise RuntimeError(f"no components after {max_rounds} rounds")


def _is_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller one, or is such a smaller one: then nothing is left to join."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    worst = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max(F.col("up") + F.when(F.col("up") > 0, F.col("down")).otherwise(0))).first()[0]
    return worst is None or worst <= 1
