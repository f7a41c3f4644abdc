"""Weighted account graphs as edge tables (src < dst, weight), and what holds of a given partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions import lift
from shoal.operators.profiles import top_k


def cooccurrence(tokens: DataFrame, weight: int = 1, max_accounts: int | None = None, owner: str = "account", token: str = "tag") -> DataFrame:
    """Pairs of owners that share tokens; weight a shared token.

    An equi-join on the token, which adaptive execution splits for frequent ones; the
    sum is pre-aggregated. ``max_accounts`` leaves out tokens of more owners, which
    bounds the pairs where a token may be on most accounts (off by default).
    """
    t = tokens.select(F.col(owner).alias("a"), F.col(token).alias("t")).distinct()
    if max_accounts is not None:
        rare = t.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_accounts).select("t")
        t = t.join(rare, "t", "left_semi")
    left, right = t.select("t", F.col("a").alias("src")), t.select("t", F.col("a").alias("dst"))
    return left.join(right, "t").where("src < dst").groupBy("src", "dst").agg((F.count(F.lit(1)) * weight).alias("weight"))


def combine(*edges: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, edges).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def bio_multiset(tokens: DataFrame, weight: int = 2) -> DataFrame:
    """Edges when repeated words count: products of multiplicities, and loops of pairs within an account."""
    m = tokens.groupBy("account", "tag").agg(F.count(F.lit(1)).alias("m"))
    l, r = m.select("tag", F.col("account").alias("src"), F.col("m").alias("ml")), m.select("tag", F.col("account").alias("dst"), F.col("m").alias("mr"))
    pair = F.when(F.col("src") == F.col("dst"), F.col("ml") * (F.col("ml") - 1) / 2).otherwise(F.col("ml") * F.col("mr"))
    return l.join(r, "tag").where("src <= dst").groupBy("src", "dst").agg((weight * F.sum(pair)).cast("long").alias("weight")).where("weight > 0")


def adaptive_prune(edges: DataFrame, sparse: DataFrame, weak: int = 2, strong: int = 6) -> DataFrame:
    """Drop edges under ``weak`` if both ends are sparse accounts, else under ``strong``."""
    s = sparse.select("account").distinct()
    if weak <= strong:  # edges of ``strong`` stay anyhow, so only those between are looked at
        light = edges.where((F.col("weight") >= weak) & (F.col("weight") < strong))
        for end in ("src", "dst"):
            light = light.join(s.select(F.col("account").alias(end)), end, "left_semi")
        return edges.where(F.col("weight") >= strong).select("src", "dst", "weight").unionByName(light.select("src", "dst", "weight"))
    marked = edges.join(s.select(F.col("account").alias("src"), F.lit(1).alias("s")), "src", "left").join(s.select(F.col("account").alias("dst"), F.lit(1).alias("d")), "dst", "left")
    both = F.col("s").isNotNull() & F.col("d").isNotNull()
    return marked.where(F.col("weight") >= F.when(both, weak).otherwise(strong)).select("src", "dst", "weight")


def ends(edges: DataFrame) -> DataFrame:
    """Both directions of each edge: (account, other, weight)."""
    return edges.select(F.col("src").alias("account"), F.col("dst").alias("other"), "weight").unionByName(edges.select(F.col("dst").alias("account"), F.col("src").alias("other"), "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """Neighbour ends of each account, a loop counting two, and their weight."""
    return ends(edges).groupBy("account").agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(edges.select(F.explode(F.array("src", "dst")).alias("account")).distinct(), "account", "left_semi")


def with_clusters(edges: DataFrame, members: DataFrame) -> DataFrame:
    m = members.select("account", "cluster")
    return edges.join(m.select(F.col("account").alias("src"), F.col("cluster").alias("c_src")), "src").join(m.select(F.col("account").alias("dst"), F.col("cluster").alias("c_dst")), "dst")


def density(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Size, internal edges and density of each cluster."""
    inner = with_clusters(edges, members).where("c_src = c_dst").groupBy(F.col("c_src").alias("cluster")).agg(F.count(F.lit(1)).alias("edges"))
    sizes = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    n = F.col("size")
    return sizes.join(inner, "cluster", "left").withColumn("edges", F.coalesce("edges", F.lit(0))).withColumn("density", F.when(n < 2, 0.0).otherwise(F.col("edges") / (n * (n - 1) / 2)))


def validity(clusters: DataFrame, least: int = 8, dense: float = 0.03) -> DataFrame:
    return clusters.withColumn("valid", (F.col("size") >= least) & (F.col("density") >= dense))


def bridges(edges: DataFrame, members: DataFrame, k: int = 3) -> DataFrame:
    """The k accounts of each cluster with most neighbours outside it."""
    m = members.select("account", "cluster")
    out = (
        ends(edges).join(m, "account").join(m.select(F.col("account").alias("other"), F.col("cluster").alias("c_other")), "other")
        .where("cluster <> c_other").groupBy("cluster", "account").agg(F.countDistinct("other").alias("external"))
    )
    return top_k(out, ["cluster"], [F.col("external").desc(), F.col("account")], k)


def cluster_tags(tags: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    counts = tags.join(members.select("account", "cluster"), "account").groupBy("cluster", "tag").agg(F.count(F.lit(1)).alias("cnt"))
    return top_k(counts, ["cluster"], [F.col("cnt").desc(), F.col("tag")], k)


def fit_scores(tags: DataFrame, members: DataFrame, top: DataFrame) -> DataFrame:
    """Share of the own cluster's top tags that an account has."""
    sizes = top.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_top"))
    hits = members.join(tags, "account").join(top.select("cluster", "tag"), ["cluster", "tag"]).groupBy("account").agg(F.count(F.lit(1)).alias("hits"))
    return members.join(sizes, "cluster", "left").join(hits, "account", "left").select("account", "cluster", F.coalesce(F.col("hits") / F.col("n_top"), F.lit(0.0)).alias("fit"))


def cross_affinity(tags: DataFrame, members: DataFrame, top: DataFrame, least: float = 0.05) -> DataFrame:
    """For each account the other cluster whose top tags it has most of."""
    sizes = top.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_top"))
    other = top.select(F.col("cluster").alias("other"), "tag").join(sizes.withColumnRenamed("cluster", "other"), "other")
    met = members.join(tags, "account").join(other, "tag").where("other <> cluster").groupBy("account", "cluster", "other").agg((F.count(F.lit(1)) / F.first("n_top")).alias("affinity"))
    return top_k(met.where(F.col("affinity") > least), ["account"], [F.col("affinity").desc(), F.col("other")], 1).drop("rank")


def entropy(counts: DataFrame, by: list[str]) -> DataFrame:
    """Shannon entropy in bits of token counts (columns by, tag, cnt) in each group."""
    total = counts.groupBy(*by).agg(F.sum("cnt").alias("n")) if by else counts.agg(F.sum("cnt").alias("n"))
    p = F.col("cnt") / F.col("n")
    joined = counts.join(total, by) if by else counts.join(F.broadcast(total))  # one row
    return joined.groupBy(*by, "n").agg((-F.sum(p * F.log2(p))).alias("entropy"))


def main_cluster(uses: DataFrame, clusters: DataFrame) -> DataFrame:
    """The cluster of tags (tag, cluster) that each account uses most, ties by cluster; accounts without any are left out."""
    counts = uses.join(clusters.select("tag", "cluster"), "tag").groupBy("account", "cluster").agg(F.count(F.lit(1)).alias("cnt"))
    return top_k(counts, ["account"], [F.col("cnt").desc(), F.col("cluster")], 1).drop("rank")


def jaccard(left: DataFrame, right: DataFrame, member: str = "account") -> DataFrame:
    """Jaccard of each pair of a left and a right group that share a member (columns l, r)."""
    nl, nr = left.groupBy("l").agg(F.count(F.lit(1)).alias("nl")), right.groupBy("r").agg(F.count(F.lit(1)).alias("nr"))
    both = left.join(right, member).groupBy("l", "r").agg(F.count(F.lit(1)).alias("both"))
    return both.join(nl, "l").join(nr, "r").withColumn("jaccard", F.col("both") / (F.col("nl") + F.col("nr") - F.col("both")))


def sound_edges(uses: DataFrame, least: int = 2) -> DataFrame:
    """Accounts that share sounds, with the sounds; sounds of one account give no pair."""
    u = uses.select("account", "sound").distinct()
    pairs = u.select("sound", F.col("account").alias("src")).join(u.select("sound", F.col("account").alias("dst")), "sound").where("src < dst")
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"), F.array_sort(F.collect_list("sound")).alias("sounds")).where(F.col("weight") >= least)


def sound_counts(edges: DataFrame, members: DataFrame, k: int = 5) -> DataFrame:
    """The k sounds that most internal edges of each cluster carry (cluster, sound, cnt, rank)."""
    inner = with_clusters(edges, members).where("c_src = c_dst").select(F.col("c_src").alias("cluster"), F.explode("sounds").alias("sound"))
    return top_k(inner.groupBy("cluster", "sound").agg(F.count(F.lit(1)).alias("cnt")), ["cluster"], [F.col("cnt").desc(), F.col("sound")], k)


def sound_lift(edges: DataFrame, members: DataFrame, k: int = 10) -> DataFrame:
    """Lift of the k commonest sounds of each cluster (parent, cluster, account) against the rest of its parent.

    A sound counts once for each edge that carries it, by member. The rest's edges have
    both ends outside the cluster: all of the parent's, less those that touch the cluster.
    """
    m = members.select("account", "parent", "cluster")
    ends_ = lambda c: m.select(F.col("account").alias(c), F.col("parent").alias(f"p_{c}"), F.col("cluster").alias(f"c_{c}"))
    e = edges.join(ends_("src"), "src").join(ends_("dst"), "dst").where("p_src = p_dst").select(F.col("p_src").alias("parent"), "c_src", "c_dst", F.explode("sounds").alias("sound"))
    e = e.groupBy("parent", "c_src", "c_dst", "sound").agg(F.count(F.lit(1)).alias("n"))
    total = e.groupBy("parent", "sound").agg(F.sum("n").alias("total"))
    touch = e.select("parent", "sound", "n", (F.col("c_src") == F.col("c_dst")).alias("inside"), F.explode(F.array_distinct(F.array("c_src", "c_dst"))).alias("cluster"))
    c = touch.groupBy("parent", "cluster", "sound").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("cnt"), F.sum("n").alias("touching")).where("cnt > 0")
    sizes = m.groupBy("parent", "cluster").agg(F.count(F.lit(1)).alias("n_in"))
    parents = m.groupBy("parent").agg(F.count(F.lit(1)).alias("n_all"))
    top = top_k(c, ["parent", "cluster"], [F.col("cnt").desc(), F.col("sound")], k)
    out = top.join(total, ["parent", "sound"]).join(sizes, ["parent", "cluster"]).join(parents, "parent")
    return out.withColumn("lift", lift(F.col("cnt"), F.col("n_in"), F.col("total") - F.col("touching"), F.col("n_all") - F.col("n_in"))).select("parent", "cluster", "sound", "cnt", "rank", "lift")
