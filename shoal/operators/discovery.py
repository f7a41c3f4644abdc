"""Finding accounts: what search hits reach the frontier, and what becomes of each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.functions import any_substring
from shoal.operators.profiles import top_k
from shoal.sources import first_wins

# The range of followers, signs of global accounts, and new accounts a probe takes.
LEAST_FOLLOWERS, MOST_FOLLOWERS = 5000, 3_000_000
REJECT_SIGNALS = ["usa", "uk", "espn", "nfl", "nba", "nhl", "mlb", "nascar", "redbull", "skysports", "talksport", "cbs", "nbc", "abc", "premierleague", "bundesliga", "seriea", "ligue1"]
PROBE = 3


def follower_range(followers: Column, least: int = LEAST_FOLLOWERS, most: int = MOST_FOLLOWERS) -> Column:
    """True within the range; unknown counts (null or 0) pass."""
    f = F.coalesce(followers, F.lit(0))
    return (f <= most) & ((f <= 0) | (f >= least))


def rejected(username: Column, display_name: Column, signals: list[str] = REJECT_SIGNALS) -> Column:
    return any_substring(F.concat_ws(" ", username, display_name), signals)


def valid_hits(hits: DataFrame, signals: list[str] = REJECT_SIGNALS, least: int = LEAST_FOLLOWERS, most: int = MOST_FOLLOWERS) -> DataFrame:
    """Hits (username, display_name, followers, …) by a named account in the range and without a reject signal."""
    return hits.where((F.coalesce("username", F.lit("")) != "") & follower_range(F.col("followers"), least, most) & ~rejected(F.col("username"), F.col("display_name"), signals))


def chain_probe(valid: DataFrame, known: DataFrame, scope: list[str], k: int = PROBE) -> DataFrame:
    """What one page of hits for each signal gives: (signal, abandoned, accounts).

    ``valid``: hits (signal, position, username, display_name, bio). If the first one has
    no sign of the scope the signal is abandoned; otherwise the first ``k`` accounts
    not in ``known`` are new. Signals don't see each other's finds.
    """
    gate = valid.groupBy("signal").agg(F.min_by(any_substring(F.concat_ws(" ", "username", "display_name", "bio"), scope), "position").alias("open"))
    fresh = first_wins(valid.join(known.select("username"), "username", "left_anti"), ["signal", "username"], ["position"])
    first = top_k(fresh.join(gate.where("open"), "signal", "left_semi"), ["signal"], [F.col("position"), F.col("username")], k)
    lists = first.groupBy("signal").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "username"))), lambda x: x["username"]).alias("accounts"))
    return gate.join(lists, "signal", "left").select("signal", (~F.col("open")).alias("abandoned"), F.coalesce("accounts", F.array().cast("array<string>")).alias("accounts"))


def discovered(valid: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """New accounts among the hits, the first hit of each."""
    return first_wins(valid.join(known.select("username"), "username", "left_anti"), ["username"], order)


def sampled_seeds(seeds: DataFrame, seed: int, k: int = 3) -> DataFrame:
    """The ``k`` seeds that a run searches; the same ones for the same ``seed``."""
    return seeds.orderBy(F.xxhash64("tag", F.lit(seed)), "tag").limit(k)


def collection_outcome(known_followers: Column, found: Column, followers: Column, scoped: Column, least: int = LEAST_FOLLOWERS) -> Column:
    """What becomes of an account, in the order in which it is tried."""
    return (
        F.when((known_followers > 0) & (known_followers < least), "skipped").when(~F.coalesce(found, F.lit(False)), "unavailable")
        .when(F.coalesce(followers, F.lit(0)) < least, "too small").when(~F.coalesce(scoped, F.lit(False)), "out of scope").otherwise("collected")
    )


def credits_left(rows: DataFrame, budget: int, by: list[str], order: list[str]) -> DataFrame:
    """Accounts that the credit budget of each session still reaches: running sum of ``credits`` below it before the account."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("spent", F.coalesce(F.sum("credits").over(w), F.lit(0))).where(F.col("spent") < budget)
