"""Connected components of an undirected graph held in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brokerlens.llm.common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 200) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges`` (a, b), both long.

    Alternating large-star and small-star rounds: each node hooks its larger neighbours, then its
    smaller ones, to the least neighbour it knows, until no edge changes.  Rounds grow with the
    logarithm of the longest chain.  Every round is two aggregates with map-side combine and two
    joins on the node, written to the shared folder; the driver sees one count and one sum."""
    e = scratch.table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                           .where(F.col("a") != F.col("b")).distinct())
    state = None
    for _ in range(max_rounds):
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        # written, so that the join's large keys can be split
        least = scratch.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = (both.where(F.col("v") > F.col("u")).join(least, "u")
                     .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct())
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b"))
        down = scratch.table(down)
        low = scratch.table(down.groupBy("a").agg(F.min("b").alias("m")))
        small = (down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                     .union(low.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct())
        nxt = scratch.table(small)
        scratch.drop(e, least, down, low)
        e = nxt
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    return (e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
             .union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
