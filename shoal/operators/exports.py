"""What leaves the engine: node table, nested clusters, requests for names and the replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A node below this fit to its own cluster is an outlier.
OUTLIER_FIT = 0.15
REPLY = "name string, description string"


def node_table(accounts: DataFrame, index: DataFrame, subs: DataFrame, fit: DataFrame, bridges: DataFrame) -> DataFrame:
    """A row for each account (account, followers, cluster) with its place and flags.

    ``index``: (cluster, cluster_index) of the valid clusters; others get null, but keep
    fit and bridge. ``subs``: (account, depth, label), the deepest label wins.
    """
    label = subs.groupBy("account").agg(F.max_by("label", "depth").alias("sub_label"))
    out = (
        accounts.join(index.select("cluster", "cluster_index"), "cluster", "left").join(label, "account", "left").join(fit.select("account", "fit"), "account", "left")
        .join(bridges.select("account", F.lit(True).alias("is_bridge")).distinct(), "account", "left")
    )
    value = F.coalesce("fit", F.lit(0.0))
    return out.select(
        "account", "followers", "cluster_index", "sub_label", F.round(value, 3).alias("fit_score"),
        ((value < OUTLIER_FIT) & F.col("cluster_index").isNotNull()).alias("is_outlier"), F.coalesce("is_bridge", F.lit(False)).alias("is_bridge"),
    )


def nested(rows: DataFrame, depth: int, fields: list[str]) -> DataFrame:
    """(path, json) of the top clusters, each with its parts inside it under ``subclusters``.

    ``rows``: (path array, size, fields), a row a cluster. Levels are folded from the
    deepest up, a pass each; parts are in order of size, then path.
    """
    key = F.array_join("path", "·")
    level = None
    for d in range(depth, 0, -1):
        at = rows.where(F.size("path") == d).select("path", key.alias("id"), "size", *fields)
        if level is None:
            body = at.withColumn("subclusters", F.lit("[]"))
        else:
            kids = level.groupBy("parent").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x["json"]), ","), F.lit("]")).alias("subclusters"))
            body = at.join(kids.withColumnRenamed("parent", "id"), "id", "left").withColumn("subclusters", F.coalesce("subclusters", F.lit("[]")))
        head = F.to_json(F.struct("id", "size", *fields))
        text = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"subclusters":'), "subclusters", F.lit("}"))
        level = body.withColumn("head", head).select("id", F.array_join(F.slice("path", 1, d - 1), "·").alias("parent"), F.struct((-F.col("size")).alias("o"), "id", text.alias("json")).alias("part"))
    return level.select("id", F.col("part.json").alias("json"))


def name_key(tags: Column) -> Column:
    """The key under which names are kept: the first five tags, sorted."""
    return F.array_join(F.array_sort(F.slice(tags, 1, 5)), ",")


def name_requests(clusters: DataFrame, names: DataFrame, kind: str) -> DataFrame:
    """(cluster, key, prompt) of the clusters (cluster, size, density, tags, accounts, hints) that have no name yet.

    The prompt states the facts a namer gets; sending it is left to the caller.
    """
    named = names.where(F.coalesce("name", F.lit("")) != "").select("key").distinct()
    marked = lambda c, mark, k: F.array_join(F.transform(F.slice(c, 1, k), lambda x: F.concat(F.lit(mark), x)), ", ")
    hints = F.when(F.size("hints") > 0, F.concat(F.lit("\nparts: "), F.array_join(F.slice("hints", 1, 4), " | "))).otherwise("")
    prompt = F.concat(
        F.lit(f"Name this {kind}.\naccounts: "), F.col("size").cast("string"), F.lit("\ndensity: "), F.round(100 * F.col("density"), 0).cast("long").cast("string"), F.lit(" %\ntags: "), marked("tags", "#", 8),
        F.lit("\nmost followed: "), marked("accounts", "@", 6), hints,
        F.lit('\nReply with JSON: {"name": three to six words without tags, "description": one sentence}'),
    )
    return clusters.withColumn("key", name_key(F.col("tags"))).join(named, "key", "left_anti").select("cluster", "key", prompt.alias("prompt"))


def parse_reply(reply: Column) -> Column:
    """Name and description of a reply, fenced or not; null fields if it can't be parsed."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.from_json(F.trim(F.when(reply.contains("```"), fenced).otherwise(reply)), REPLY)
