"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskspark.llm.common import staged


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours (all larger ones, or the node and its smaller ones) at the smallest neighbour.

    The smallest neighbour comes from an aggregate that combines before the shuffle and
    is joined back, so a node with very many links is split like any skewed join side.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if large:
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: the smallest node reachable; only linked nodes appear.

    Every round is written to the shared folder, so a lost executor costs one round.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct(), "links")
    mark = None
    for _ in range(rounds):
        edges = staged(_stars(_stars(edges, True), False), "stars")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
