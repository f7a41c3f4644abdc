"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm._base import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a > b): neighbours are tied to the least neighbour.

    Large star ties the larger neighbours of each node, small star the smaller ones
    and the node itself. The minimum is pre-aggregated before the shuffle; the join
    back is a plain equi-join, which adaptive execution splits for hot nodes.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        tied = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        tied = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return tied.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node reachable, for each node that has an edge.

    ``edges`` has long columns a and b in any direction; self-loops and repeats do
    no harm; an empty table gives an empty result. Each round is written to the
    shared folder, so lineage stays short. Only counts reach the driver.
    """
    now = materialise(
        edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), narrow=True
    )
    before = None
    for _ in range(max_rounds):
        stars = materialise(_star(_star(now, large=True), large=False), narrow=True)
        # A step that changes nothing leaves the same edges: compare count and an order-free checksum.
        state = stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        now = stars
        if state[0] == state[2] and state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
