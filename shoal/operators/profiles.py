"""Token profiles of accounts: counts, top k, fallbacks, trackers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import lift


def token_counts(rows: DataFrame, owner: str = "account", token: str = "tag") -> DataFrame:
    return rows.where(F.col(token).isNotNull()).groupBy(owner, token).agg(F.count(F.lit(1)).alias("cnt"))


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the limit is pushed below the shuffle by WindowGroupLimit."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(w).cast("long")).where(F.col(rank) <= k)


def profile(rows: DataFrame, k: int, owner: str = "account", token: str = "tag") -> DataFrame:
    """Top-k tokens of each owner by count, ties by token."""
    return top_k(token_counts(rows, owner, token), [owner], [F.col("cnt").desc(), F.col(token)], k)


def profiles(rows: DataFrame, k: dict[str, int], owner: str = "account") -> DataFrame:
    """The profiles of several token columns of one type (owner, kind, tag): kind numbers the columns as listed, each with its k. One shuffle, by owner."""
    stack = ", ".join(f"{i}, {c}" for i, c in enumerate(k))
    each = rows.repartition(owner).selectExpr(owner, f"stack({len(k)}, {stack}) AS (kind, tag)").where("tag IS NOT NULL")
    counts = each.groupBy(owner, "kind", "tag").agg(F.count(F.lit(1)).alias("cnt"))
    most = F.element_at(F.array(*map(F.lit, k.values())), F.col("kind") + 1)
    return top_k(counts, [owner, "kind"], [F.col("cnt").desc(), F.col("tag")], max(k.values())).where(F.col("rank") <= most).select(owner, "kind", "tag")


def with_fallback(accounts: DataFrame, profiles: DataFrame, stored: Column) -> DataFrame:
    """Tags of each account from its profile, the stored ones if it has none."""
    lists = profiles.groupBy("account").agg(F.array_sort(F.collect_list("tag")).alias("tags_"))
    return accounts.join(lists, "account", "left").withColumn("tags", F.coalesce("tags_", stored)).drop("tags_")


def corpus_counts(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("tag").agg(F.countDistinct("account").alias("accounts"))


def tag_tracker(rows: DataFrame, accounts_total: Column, min_mentions: int = 3) -> DataFrame:
    return (
        rows.groupBy("tag").agg(F.count(F.lit(1)).alias("mentions"), F.countDistinct("account").alias("unique_accounts"))
        .where(F.col("mentions") >= min_mentions)
        .withColumn("coverage_pct", F.round(100 * F.col("unique_accounts") / accounts_total, 1))
    )


def tag_class(coverage: Column, is_seed: Column, has_signal: Column) -> Column:
    """Classes in the order in which they are tried; coverage is a share."""
    return F.when(coverage > 0.3, "GENERAL").when(~is_seed & ~has_signal, "NEW-DISCOVERY").when(is_seed, "SEED").otherwise("DUTCH-KNOWN")


def seed_activity(mentions: DataFrame, seeds: DataFrame, least: int = 3) -> DataFrame:
    return seeds.join(mentions, "tag", "left").agg(F.count(F.lit(1)).alias("seeds"), F.count_if(F.col("mentions") >= least).alias("active"))


def saturation(novel_pct: Column) -> Column:
    return F.when(novel_pct >= 50, "LOW").when(novel_pct >= 20, "MODERATE").otherwise("HIGH")


def novelty(old: DataFrame, new: DataFrame, key: str = "tag") -> DataFrame:
    """New, repeated and gone keys between two snapshots, and the share of new ones."""
    o, n = old.select(key).distinct().withColumn("o", F.lit(1)), new.select(key).distinct().withColumn("n", F.lit(1))
    out = o.join(n, key, "full_outer").agg(
        F.count_if(F.col("o").isNull()).alias("fresh"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("repeated"), F.count_if(F.col("n").isNull()).alias("gone"),
    )
    pct = F.round(100 * F.col("fresh") / F.greatest(F.col("fresh") + F.col("repeated"), F.lit(1)), 1)
    return out.withColumn("novel_pct", pct).withColumn("saturation", saturation(pct))


def group_lift(tags: DataFrame, group: str, parent: str) -> DataFrame:
    """Lift of each tag in each group against the rest of the group's parent.

    ``tags``: distinct (account, tag, group, parent) rows; accounts without tags do not count.
    """
    sizes = tags.select("account", group, parent).distinct().groupBy(parent, group).agg(F.count(F.lit(1)).alias("n_in"))
    parents = sizes.groupBy(parent).agg(F.sum("n_in").alias("n_parent"))
    c_in = tags.groupBy(parent, group, "tag").agg(F.count(F.lit(1)).alias("c_in"))
    c_all = tags.groupBy(parent, "tag").agg(F.count(F.lit(1)).alias("c_parent"))
    out = c_in.join(c_all, [parent, "tag"]).join(sizes, [parent, group]).join(parents, parent)
    return out.withColumn("lift", lift(F.col("c_in"), F.col("n_in"), F.col("c_parent") - F.col("c_in"), F.col("n_parent") - F.col("n_in")))


def chain_signals(profiles: DataFrame, rows: DataFrame, common: int = 30, least: int = 2, k: int = 3) -> DataFrame:
    """Tags an account uses often that few others use: frequency over corpus frequency + 1."""
    corpus = profiles.groupBy("tag").agg(F.count(F.lit(1)).alias("corpus"))
    counts = token_counts(rows).join(corpus, "tag", "left").withColumn("corpus", F.coalesce("corpus", F.lit(0)))
    scored = counts.where((F.col("corpus") < common) & (F.col("cnt") >= least)).withColumn("score", F.col("cnt") / (F.col("corpus") + 1))
    return top_k(scored, ["account"], [F.col("score").desc(), F.col("tag")], k)


def rebuild(accounts: DataFrame, videos: DataFrame, min_videos: int = 1, k: int = 50) -> DataFrame:
    """Accounts (account, in_scope, fully_collected, tags) with tags anew from their videos (account, video, tag).

    Only collected accounts in scope with ``min_videos`` videos and a tag change.
    """
    enough = videos.groupBy("account").agg(F.countDistinct("video").alias("n")).where(F.col("n") >= min_videos)
    top = profile(videos.join(enough, "account", "left_semi"), k).groupBy("account").agg(F.array_sort(F.collect_list(F.struct("rank", "tag"))).alias("new_"))
    hit = F.coalesce(F.col("fully_collected") & F.col("in_scope"), F.lit(False)) & F.col("new_").isNotNull()
    out = accounts.join(top, "account", "left")
    return out.withColumn("rebuilt", hit).withColumn("tags", F.when(hit, F.transform("new_", lambda x: x["tag"])).otherwise(F.col("tags"))).drop("new_")
