"""Connected components of an edge table, with DataFrame operations only.

Distributed union-find by alternating large-star and small-star steps: each
step links every node's neighbours to the smallest of them. Minima are
aggregated before the shuffle, so a node with very many neighbours is no hot
key there, and they are written before they are joined, so that both sides of
the join have a shuffle of their own that adaptive execution can split. The
steps end when all edges lead to the least node of their component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingestloom.llm.scratch import materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b) with a > b; returns edges of the same form."""
    if large:
        near = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    else:
        near = edges
    least = materialize(near.groupBy("a").agg(F.min("b").alias("m")))
    joined = near.join(least, "a")
    if large:  # neighbours above a node go to the least of its neighbourhood
        out = joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
    else:  # a node and its lesser neighbours go to the least of them
        out = joined.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
    return out.where("a > b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node below which another stands has no further edge: every edge then leads to the least of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n")).where("up > 0 and n > 1").agg(F.count("*")).first()[0] == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that is not the least of its component.

    ``component`` is the least node reachable. Loops, repeats and null ends are
    ignored; no edges give an empty result.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialize(edges.where("a is not null and b is not null and a <> b").select(high.alias("a"), low.alias("b")).distinct())
    for _ in range(MAX_ROUNDS):
        if _are_stars(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        large = materialize(_star(edges, True))
        edges = materialize(_star(large, False))
    raise RuntimeError("components did not settle")


def join_components(linked: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) of what the components ``linked`` become by further edges (a, b): only their least nodes are linked anew."""
    for side in ("a", "b"):
        edges = edges.join(linked.select(F.col("node").alias(side), F.col("component").alias(f"_{side}")), side, "left")
    raised = connected_components(edges.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")))
    above = raised.toDF("component", "to")
    return linked.join(above, "component", "left").select("node", F.coalesce("to", "component").alias("component")).unionByName(raised)
