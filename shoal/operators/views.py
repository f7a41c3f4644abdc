"""Queries over hierarchies: dial, plateaus, traces, memberships, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_paths(members: DataFrame, path: str = "path") -> DataFrame:
    """A row for each cluster that holds an account, from the top one down."""
    parts = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, 1, i), "·"))
    return members.select("*", F.posexplode(parts).alias("depth", "cluster_path"))


def lifespans(tree: DataFrame) -> DataFrame:
    """Intervals of a tree (id, parent, split_at): a node is born where its parent splits."""
    parent = tree.select(F.col("id").alias("parent"), F.least("split_at", F.lit(1.0)).alias("born"))
    out = tree.join(parent, "parent", "left").withColumn("born", F.coalesce("born", F.lit(0.0))).withColumn("dies", F.least("split_at", F.lit(1.0)))
    return out.withColumn("robust", F.col("dies") - F.col("born") >= 0.18)


def alive(spans: DataFrame, dial: DataFrame) -> DataFrame:
    """Clusters alive at each dial value: born <= value < dies (a leaf lives on at 1)."""
    inside = (F.col("born") <= F.col("dial")) & ((F.col("dial") < F.col("dies")) | (F.col("dies") >= 1))
    return spans.join(F.broadcast(dial), inside)  # the dial is a list of positions


def plateaus(tree: DataFrame) -> DataFrame:
    """Stretches between consecutive breakpoints, from 0 to 1."""
    breaks = tree.where("split_at < 1").select(F.col("split_at").alias("b")).distinct()
    edge = breaks.sparkSession.createDataFrame([(0.0,), (1.0,)], "b double")
    w = Window.orderBy("b")  # as many rows as the tree has splits
    out = breaks.unionByName(edge).distinct().withColumn("to", F.lead("b").over(w)).where(F.col("to").isNotNull())
    return out.select(F.col("b").alias("lo"), F.col("to").alias("hi"), F.round(F.col("to") - F.col("b"), 6).alias("width"))


def distance_to_break(dial: DataFrame, tree: DataFrame) -> DataFrame:
    """Distance of each dial value to the nearest breakpoint, and stability min(dist / 0.16, 1)."""
    breaks = tree.where("split_at < 1").agg(F.collect_set("split_at").alias("bs"))  # one row
    dist = F.array_min(F.transform("bs", lambda b: F.abs(b - F.col("dial"))))
    return dial.join(F.broadcast(breaks)).select("dial", F.round(dist, 6).alias("dist"), F.round(F.least(dist / 0.16, F.lit(1.0)), 6).alias("stability"))


def collapse(rows: DataFrame, by: str, order: str, state: str) -> DataFrame:
    """Keep the first of consecutive rows in the same state."""
    before = F.lag(state).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("before_", before).where(F.col("before_").isNull() | (F.col("before_") != F.col(state))).drop("before_")


def membership_rules(members: DataFrame) -> DataFrame:
    """Accounts by their strongest membership; under 0.30 they count as unknown."""
    best = members.groupBy("account").agg(F.max("membership").alias("best"))
    return best.withColumn("state", F.when(F.col("best") < 0.30, "unknown").otherwise("member"))


def persistence_state(persistence):
    return F.when(persistence.isNull(), "neutral").when(persistence < 0.4, "ephemeral").otherwise("lasting")


def publish_diff(old: DataFrame, new: DataFrame, least: int = 10) -> DataFrame:
    """Clusters (cluster, size) that appeared, vanished or changed by ``least`` members."""
    o, n = old.select("cluster", F.col("size").alias("old_size")), new.select("cluster", F.col("size").alias("new_size"))
    change = (
        F.when(F.col("old_size").isNull(), "appeared").when(F.col("new_size").isNull(), "disappeared")
        .when(F.abs(F.col("new_size") - F.col("old_size")) >= least, "changed").otherwise("unchanged")
    )
    return o.join(n, "cluster", "full_outer").withColumn("change", change)


def new_parts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Parts (cluster, part) of clusters known before that were not there then."""
    return new.select("cluster", "part").distinct().join(old.select("cluster").distinct(), "cluster", "left_semi").join(old.select("cluster", "part").distinct(), ["cluster", "part"], "left_anti")


def contract_violations(blocks: DataFrame, overlaps: DataFrame, recommended: int) -> DataFrame:
    """(rule, id) of blocks (id, level, parent, kind) and overlaps (id, between) that break the contract.

    The recommended level has blocks; a parent exists, has the same kind and lies one
    level above; an overlap names two different blocks that exist.
    """
    up = blocks.select(F.col("id").alias("parent"), F.lit(True).alias("there"), F.col("kind").alias("up_kind"), F.col("level").alias("up_level"))
    kids = blocks.where("parent is not null").join(up, "parent", "left")
    named = overlaps.select("id", F.explode_outer("between").alias("block")).join(blocks.select(F.col("id").alias("block"), F.lit(1).alias("hit")), "block", "left")
    sound = named.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.when(F.col("hit").isNotNull(), F.col("block"))).alias("known"))
    level = blocks.agg(F.count_if(F.col("level") == recommended).alias("n")).where("n = 0").select(F.lit("recommended level").alias("rule"), F.lit(str(recommended)).alias("id"))
    return (
        level.unionByName(kids.where("there is null").select(F.lit("parent exists").alias("rule"), "id"))
        .unionByName(kids.where("up_kind <> kind").select(F.lit("parent of same kind").alias("rule"), "id"))
        .unionByName(kids.where("up_level + 1 <> level").select(F.lit("parent one level above").alias("rule"), "id"))
        .unionByName(sound.where("n <> 2 or known <> 2").select(F.lit("overlap of two blocks").alias("rule"), "id"))
    )
