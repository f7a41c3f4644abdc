"""Queries over the given tables: each binds operators to them and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shoal import functions as fn
from shoal.operators import axes, community, discovery, exports, graph, profiles, ties, views
from shoal.operators._lineage import stored
from shoal.plans import bindings as b
from shoal.sources import first_wins, frontier, in_scope, json_array, latest, set_flags, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# Tables and merges


@query
def table_stats(s, d):
    one = lambda n, t: table(s, d, t).agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return one("accounts", "customer").unionByName(one("videos", "orders")).unionByName(one("tags", "lineitem"))


@query
def snapshot_stats(s, d):
    return b.accounts(s, d).agg(F.count(F.lit(1)).alias("accounts"), F.count_if("fully_collected").alias("collected"), F.count_if(F.col("fully_collected") & F.col("in_scope")).alias("in_scope"), F.sum("followers").cast("long").alias("followers"))


@query
def latest_upsert(s, d):
    return latest(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", r6("value").alias("value"))


@query
def first_wins_dedup(s, d):
    return first_wins(table(s, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query
def flag_update(s, d):
    a = b.accounts(s, d)
    out = set_flags(a, a.where("bio = 'BUILDING'"), "account", in_scope=False, fully_collected=True)
    return out.groupBy("fully_collected", F.coalesce(F.col("in_scope").cast("string"), F.lit("unknown")).alias("scope")).agg(F.count(F.lit(1)).alias("n"))


@query
def in_scope_filter(s, d):
    return in_scope(b.accounts(s, d)).select("account", "followers")


@query
def json_tags(s, d):
    """Tags packed as JSON in a text cell, unpacked; what can't be parsed counts as empty."""
    packed = table(s, d, "events").select("user_id", F.concat(F.lit('["k'), F.get_json_object("props", "$.k"), F.when(F.col("event_id") % 7 == 0, "").otherwise('"]')).alias("j"))
    return packed.select("user_id", F.size(F.coalesce(json_array(F.col("j")), F.array().cast("array<string>"))).alias("n")).groupBy("user_id").agg(F.sum("n").alias("tags"))


@query
def url_username(s, d):
    return table(s, d, "pages").select("page_id", fn.url_username(F.col("url")).alias("username"))


@query
def snapshot_append(s, d):
    return table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("snapshot")).agg(F.count(F.lit(1)).alias("events"), F.countDistinct("user_id").alias("accounts"))


# Profiles


@query
def account_tag_profile_topk(s, d):
    return profiles.profile(b.uses(s, d), 50).select("account", "tag", "cnt", "rank")


@query
def account_tag_profile_k20(s, d):
    return profiles.profile(b.brand_uses(s, d), 20).select("account", "tag", "cnt", "rank")


@query
def profile_fallback_join(s, d):
    out = profiles.with_fallback(b.accounts(s, d), b.brands(s, d), F.array("bio"))
    return out.select("account", F.array_join("tags", ",").alias("tags"))


@query
def caption_keywords_topk(s, d):
    words = table(s, d, "documents").select(F.col("source").alias("account"), F.explode(fn.caption_words(F.col("text"))).alias("tag"))
    return profiles.profile(words, 30).select("account", "tag", "cnt", "rank")


@query
def bio_tokens_multiset(s, d):
    words = b.bio_tokens(s, d).select("account", F.explode(F.array("tag", F.when(F.col("account") % 3 == 0, F.col("tag")).otherwise(F.col("account").cast("string")))).alias("tag"))
    return graph.bio_multiset(words).groupBy((F.col("src") == F.col("dst")).alias("loop")).agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))


@query
def mentions_extract(s, d):
    return table(s, d, "documents").select("doc_id", F.explode(fn.mentions(F.col("text"))).alias("mention"))


@query
def mentions_frequent(s, d):
    m = table(s, d, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit(r"@([\p{L}\p{N}_.]+)"), 1)).alias("mention"))
    counts = m.where(F.length("mention") > 2).groupBy("source", "mention").agg(F.count(F.lit(1)).alias("cnt"))
    return profiles.top_k(counts, ["source"], [F.col("cnt").desc(), F.col("mention")], 10).where("cnt >= 2").select("source", "mention", "cnt")


@query
def language_share_scope(s, d):
    share = F.avg((F.col("lang") == "de").cast("double"))
    return table(s, d, "documents").where("lang is not null").groupBy("source").agg(r6(share).alias("share")).withColumn("scope", F.col("share") >= 0.2)


@query
def scope_classifier(s, d):
    """First hit wins: language share, then a signal in the biography, then a signal among the tags."""
    a, t = b.accounts(s, d), b.brands(s, d)
    hit = t.where(F.col("tag").isin("Brand#11", "Brand#55")).select("account").distinct().withColumn("tag_hit", F.lit(True))
    share = b.uses(s, d).groupBy("account").agg(F.avg((F.col("sound") % 5 == 0).cast("double")).alias("share"))
    tier = F.when(F.col("share") >= 0.2, 0).when(fn.any_substring(F.concat_ws(" ", "bio", "name"), ["mach", "house"]), 1).when(F.col("tag_hit"), 2).otherwise(-1)
    return a.join(share, "account", "left").join(hit, "account", "left").select("account", tier.cast("long").alias("tier"))


@query
def corpus_tag_counts(s, d):
    return profiles.corpus_counts(b.tags(s, d))


@query
def first_k_distinct(s, d):
    first = table(s, d, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("f")).select("user_id", "event_type", "f.ts", "f.event_id")
    return profiles.top_k(first, ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("user_id", "event_type", "rank")


@query
def chain_signals(s, d):
    return profiles.chain_signals(b.tags(s, d, 20), b.uses(s, d)).select("account", "tag", "cnt", "corpus", r6("score").alias("score"))


@query
def tag_tracker(s, d):
    total = table(s, d, "customer").agg(F.count(F.lit(1)).alias("total"))
    return profiles.tag_tracker(b.uses(s, d).join(F.broadcast(total)).withColumn("one", F.lit(1)), F.lit(1.0)).drop("coverage_pct").join(F.broadcast(total)).select("tag", "mentions", "unique_accounts", F.round(100 * F.col("unique_accounts") / F.col("total"), 1).alias("coverage_pct"))


@query
def tag_classes(s, d):
    total = table(s, d, "customer").agg(F.count(F.lit(1)).alias("total"))
    t = b.brand_uses(s, d).groupBy("tag").agg(F.countDistinct("account").alias("accounts")).join(F.broadcast(total))
    share = F.col("accounts") / F.col("total") - 0.4
    return t.select("tag", "accounts", profiles.tag_class(share, F.col("tag").isin("Brand#11", "Brand#23"), F.col("tag").contains("#5")).alias("class"))


@query
def seed_activity(s, d):
    seeds = table(s, d, "part").where("p_partkey <= 60").select(F.col("p_partkey").alias("tag"))
    mentions = b.uses(s, d).groupBy("tag").agg(F.count(F.lit(1)).alias("mentions"))
    return profiles.seed_activity(mentions, seeds, 30)


@query
def discovery_novelty(s, d):
    u = b.titled_uses(s, d)
    split = F.lit(b.SPLIT).cast("timestamp_ntz")
    return profiles.novelty(u.where(F.col("ts") < split), u.where(F.col("ts") >= split), "sound")


# Graph


@query
def cooccurrence_edges(s, d):
    return graph.cooccurrence(b.tags(s, d), 3).where("weight >= 6")


@query
def top_edges(s, d):
    e = graph.cooccurrence(b.tags(s, d)).where("weight >= 2")
    return e.orderBy(F.col("weight").desc(), "src", "dst").limit(100)


@query
def multi_signal_edges(s, d):
    return b.signals(s, d, b.tag_and_sound_profiles(s, d), 4)


def _pruned(s, d, weak, strong):
    kept = b.tag_and_sound_profiles(s, d)
    sparse = kept.where("kind = 0").groupBy("account").agg(F.count(F.lit(1)).alias("n")).where("n <= 20")
    return graph.adaptive_prune(stored(b.signals(s, d, kept, min(weak, strong))), sparse, weak, strong)


@query
def adaptive_prune(s, d):
    return _pruned(s, d, weak=4, strong=7)


@query
def connected_nodes(s, d):
    return graph.connected(b.accounts(s, d), _pruned(s, d, weak=4, strong=9)).select("account", "followers")


@query
def node_degree(s, d):
    return graph.degrees(b.edges(s, d))


@query
def sound_stats(s, d):
    names = table(s, d, "supplier").select(F.col("s_suppkey").alias("sound"), F.col("s_name").alias("title"))
    u = b.uses(s, d).join(in_scope(b.accounts(s, d)).select("account"), "account")
    return u.groupBy("sound").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("account").alias("accounts")).join(names, "sound").select("sound", "title", "uses", "accounts")


@query
def sound_originals_split(s, d):
    """Sounds by accounts, twenty of each kind; a title of an even number plays the original."""
    t = sound_stats(s, d).withColumn("original", F.col("title").rlike("[02468]$"))
    return profiles.top_k(t, ["original"], [F.col("accounts").desc(), F.col("sound")], 20).select("original", "sound", "accounts", "rank")


@query
def sound_edges(s, d):
    return graph.sound_edges(b.titled_uses(s, d)).select("src", "dst", "weight", F.array_join("sounds", ",").alias("sounds"))


@query
def sound_vs_tag_jaccard(s, d):
    left = b.uses(s, d).select(F.col("sound").alias("l"), "account").distinct()
    right = b.members(s, d).select(F.col("cluster").alias("r"), "account")
    return graph.jaccard(left, right).select("l", "r", "both", r6("jaccard").alias("jaccard"))


@query
def tag_tag_cooccurrence(s, d):
    return graph.cooccurrence(b.brand_uses(s, d).select("video", "tag"), 1, owner="tag", token="video")


@query
def account_main_cluster(s, d):
    return graph.main_cluster(b.uses(s, d), table(s, d, "part").select(F.col("p_partkey").alias("tag"), F.col("p_brand").alias("cluster")))


@query
def tag_communities(s, d):
    """Tags within the frequency band, tied by the videos they share, in communities; accounts go to the one they use most."""
    videos = stored(b.uses(s, d).groupBy("video").agg(F.collect_list(F.struct("account", "tag")).alias("uses")))
    u = videos.select(F.explode("uses").alias("use")).select("use.account", "use.tag")
    shared = videos.select(F.array_distinct(F.filter("uses.tag", lambda x: x.isNotNull())).alias("tags"))
    found = ties.communities(shared, _band(s, d, u).select("tag"))
    return graph.main_cluster(u, found.withColumnRenamed("account", "tag"))


def _band(s, d, uses):
    total = F.broadcast(table(s, d, "customer").agg(F.count(F.lit(1)).alias("total")))
    return profiles.corpus_counts(uses).join(total).where("accounts >= 3 and accounts <= 0.4 * total").select("tag", "accounts")


@query
def df_band_filter(s, d):
    return _band(s, d, b.uses(s, d))


# A given partition


@query
def cluster_density(s, d):
    return graph.validity(graph.density(b.edges(s, d), b.members(s, d))).select("cluster", "size", "edges", r6("density").alias("density"), "valid")


@query
def cluster_reach(s, d):
    return b.members(s, d).groupBy("cluster").agg(F.sum("followers").cast("long").alias("reach"))


@query
def cluster_top_accounts(s, d):
    return profiles.top_k(b.members(s, d), ["cluster"], [F.col("followers").desc(), F.col("account")], 10).select("cluster", "account", "rank")


@query
def cluster_index(s, d):
    sizes = b.members(s, d).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    w = Window.orderBy(F.col("size").desc(), "cluster")  # a row a cluster
    return sizes.withColumn("cluster_index", F.row_number().over(w).cast("long"))


@query
def cluster_top_tags(s, d):
    return graph.cluster_tags(b.brands(s, d), b.members(s, d)).select("cluster", "tag", "cnt", "rank")


@query
def cluster_bridges(s, d):
    return graph.bridges(b.edges(s, d), b.members(s, d)).select("cluster", "account", "external", "rank")


def _fit(s, d):
    t, m = b.brands(s, d), b.members(s, d)
    return graph.fit_scores(t, m, graph.cluster_tags(t, m))


@query
def fit_scores(s, d):
    return _fit(s, d).select("account", "cluster", r6("fit").alias("fit"))


@query
def mean_fit(s, d):
    return _fit(s, d).groupBy("cluster").agg(r6(F.avg("fit") + 1e-9).alias("mean_fit"))  # exact halves go up in any engine


@query
def outliers(s, d):
    out = _fit(s, d).where("fit < 0.15")
    return profiles.top_k(out, ["cluster"], [F.col("fit"), F.col("account")], 4).select("cluster", "account", r6("fit").alias("fit"), "rank")


@query
def cross_affinity(s, d):
    t, m = b.brands(s, d), b.members(s, d, "macro")
    return graph.cross_affinity(t, m, graph.cluster_tags(t, m)).select("account", "cluster", "other", r6("affinity").alias("affinity"))


def _lift(s, d):
    a = b.accounts(s, d).select("account", "macro", "sub")
    return profiles.group_lift(b.brands(s, d).join(a, "account"), "sub", "macro")


@query
def lift(s, d):
    return _lift(s, d).select("sub", "tag", "c_in", r6("lift").alias("lift"))


@query
def distinctive_tags(s, d):
    t = _lift(s, d).where("lift >= 1.2")
    top = profiles.top_k(t, ["sub"], [F.round("lift", 6).desc(), F.col("tag")], 3)
    lists = top.groupBy("sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))
    return lists.select("sub", fn.label_hint(F.col("tags")).alias("hint"))


def _counts(s, d, by):
    a = b.accounts(s, d).select("account", "macro", "sub")
    return b.brands(s, d).join(a, "account").groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("cnt"))


@query
def tag_entropy(s, d):
    return graph.entropy(_counts(s, d, ["macro"]), ["macro"]).select("macro", r6("entropy").alias("entropy"))


@query
def variance_ratio(s, d):
    """How much of a region's tag entropy its nations explain."""
    whole = graph.entropy(_counts(s, d, ["macro"]), ["macro"]).select("macro", F.col("entropy").alias("h"))
    parts = graph.entropy(_counts(s, d, ["macro", "sub"]), ["macro", "sub"])
    sizes = b.accounts(s, d).groupBy("macro", "sub").agg(F.count(F.lit(1)).alias("size"))
    inner = parts.join(sizes, ["macro", "sub"]).groupBy("macro").agg((F.sum(F.col("size") * F.col("entropy")) / F.sum("size")).alias("hi"))
    ratio = F.when(F.col("h") < 0.01, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("hi") / F.col("h")))
    return whole.join(inner, "macro").select("macro", r6(ratio).alias("ratio"))


@query
def macro_confidence(s, d):
    c = graph.density(b.edges(s, d), b.members(s, d, "macro"))
    score = fn.macro_confidence(F.col("size"), F.col("density"))
    return c.select("cluster", score.alias("confidence"), fn.confidence_label(score).alias("label"))


@query
def sub_confidence(s, d):
    c = graph.density(b.edges(s, d), b.members(s, d))
    top = _lift(s, d).groupBy(F.col("sub").alias("cluster")).agg(F.max("lift").alias("top"))
    score = fn.sub_confidence(F.col("size"), F.col("density"), F.col("top"), F.lit(1))
    return c.join(top, "cluster").select("cluster", score.alias("confidence"), fn.confidence_label(score).alias("label"))


def _top_lists(s, d, k=5):
    top = graph.cluster_tags(b.brands(s, d), b.members(s, d), k)
    return top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "tag"))), lambda x: x["tag"]).alias("tags"))


@query
def cluster_fingerprint(s, d):
    return _top_lists(s, d).select("cluster", fn.fingerprint(F.col("tags")).alias("fingerprint"))


@query
def fingerprint_name_match(s, d):
    """The name whose fingerprint shares most tags with a cluster's, all but one at least."""
    names = s.createDataFrame([("north", "Brand#11,Brand#12,Brand#13"), ("south", "Brand#21,Brand#55"), ("east", "Brand#33,Brand#34")], "name string, fp string")
    want = names.select("name", F.size(F.split("fp", ",")).alias("n"), F.explode(F.split("fp", ",")).alias("tag"))
    have = graph.cluster_tags(b.brands(s, d), b.members(s, d), 10).select("cluster", "tag")
    hits = have.join(F.broadcast(want), "tag").groupBy("cluster", "name").agg(F.count(F.lit(1)).alias("score"), F.first("n").alias("n"))  # three names
    return profiles.top_k(hits.where(F.col("score") >= F.greatest(F.lit(1), F.col("n") - 1)), ["cluster"], [F.col("score").desc(), F.col("name")], 1).select("cluster", "name", "score")


@query
def cluster_summary(s, d):
    lists, br = _top_lists(s, d, 8), graph.bridges(b.edges(s, d), b.members(s, d))
    names = br.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "account"))), lambda x: x["account"].cast("string")), ",").alias("bridges"))
    return lists.join(names, "cluster", "left").select("cluster", F.array_join("tags", ",").alias("tags"), F.coalesce("bridges", F.lit("")).alias("bridges"))


@query
def publish_diff(s, d):
    o = table(s, d, "orders").join(b.accounts(s, d).select(F.col("account").alias("o_custkey"), "sub"), "o_custkey")
    split = F.lit(b.SPLIT).cast("timestamp_ntz")
    size = lambda rows: rows.groupBy(F.col("sub").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return views.publish_diff(size(o.where((F.col("o_orderdate") < split) & (F.col("sub") != 3))), size(o.where((F.col("o_orderdate") >= split) & (F.col("sub") != 7))))


# Hierarchy


def _paths(s, d):
    return b.accounts(s, d).select("account", "followers", F.array(F.col("macro").cast("string"), F.col("sub").cast("string"), F.col("bio")).alias("path"))


@query
def path_labels(s, d):
    n = table(s, d, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_name")
    return n.select("n_nationkey", F.concat((F.col("n_regionkey") + 1).cast("string"), F.char(96 + F.row_number().over(w))).alias("label"))


@query
def path_prefix_members(s, d):
    return views.expand_paths(_paths(s, d)).groupBy(F.col("cluster_path").alias("path")).agg(F.count(F.lit(1)).alias("members"), F.sum("followers").cast("long").alias("reach"))


@query
def account_memberships(s, d):
    return _paths(s, d).select("account", F.array_join(fn.path_prefixes(F.col("path")), " > ").alias("paths"))


@query
def descendant_count(s, d):
    p = views.expand_paths(_paths(s, d)).select("cluster_path").distinct().select(F.split("cluster_path", "·").alias("path"))
    up = views.expand_paths(p.withColumnRenamed("path", "full"), "full").where(F.col("depth") < F.size("full") - 1)
    return up.groupBy(F.col("cluster_path").alias("path")).agg(F.count(F.lit(1)).alias("descendants"))


# Frontier and strategy


@query
def frontier_by_followers(s, d):
    return frontier(b.accounts(s, d)).orderBy(F.col("followers").desc(), "account").limit(200).select("account", "followers")


@query
def frontier_scored(s, d):
    """Frontier accounts by reach and the share of their tags outside the commonest ones."""
    t = b.tags(s, d, 20)
    common = profiles.corpus_counts(t).orderBy(F.col("accounts").desc(), "tag").limit(300).select("tag", F.lit(1).alias("common"))
    nov = t.join(F.broadcast(common), "tag", "left").groupBy("account").agg(F.avg(F.col("common").isNull().cast("double")).alias("novelty"))  # 300 tags
    default = F.when(F.col("followers") > 200_000, 0.1).otherwise(0.5)
    a = frontier(b.accounts(s, d)).join(nov, "account", "left").withColumn("priority", F.col("account") % 50 == 1)
    a = a.withColumn("score", F.round(fn.frontier_score(F.col("followers"), F.coalesce("novelty", default)), 6))
    return a.orderBy(F.col("priority").desc(), F.col("score").desc(), "account").limit(500).select("account", "priority", "score")


@query
def frontier_with_signal(s, d):
    return frontier(b.accounts(s, d)).join(b.uses(s, d).select("account"), "account", "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query
def strategy_bridges(s, d):
    br = graph.bridges(b.edges(s, d), b.members(s, d)).join(b.accounts(s, d).select("account", "followers"), "account")
    return br.where("followers >= 500").orderBy(F.col("followers").desc(), "account").limit(8).select("account", "cluster", "followers")


@query
def boundary_tags(s, d):
    br = graph.bridges(b.edges(s, d), b.members(s, d)).select("account")
    return b.brands(s, d).join(br, "account", "left_semi").groupBy("tag").agg(F.count(F.lit(1)).alias("cnt")).where("cnt >= 2").orderBy(F.col("cnt").desc(), "tag").limit(12)


# Axes


def _axes(s, d):
    side = F.broadcast(b.lexicons(s))  # 25 terms
    n = lambda x: F.count_if(F.col("side") == x)
    t = b.brands(s, d).join(b.members(s, d), "account").join(side, "tag", "left").groupBy("cluster").agg(
        n("left").alias("l"), n("right").alias("r"), n("trust").alias("t"), n("distrust").alias("u"), n("faith").alias("f"), F.count(F.lit(1)).alias("tags"))
    reach = b.members(s, d).groupBy("cluster").agg(F.log1p(F.sum("followers").cast("double")).alias("reach"))
    return t.join(reach, "cluster").select("cluster", "tags", fn.normalised_difference(F.col("r"), F.col("l")).alias("political"), fn.normalised_difference(F.col("t"), F.col("u")).alias("trust"), (F.col("f") / F.col("tags")).alias("faith"), "reach")


@query
def axis_scores(s, d):
    return _axes(s, d).select("cluster", "tags", *(r6(c).alias(c) for c in ("political", "trust", "faith", "reach")))


@query
def axis_minmax(s, d):
    cols = ["political", "trust", "faith", "reach"]
    return axes.min_max(_axes(s, d), cols).select("cluster", *(r6(c).alias(c) for c in cols))


@query
def axis_gaps(s, d):
    """Axes on which the macro clusters hardly differ."""
    long = _axes(s, d).unpivot("cluster", ["political", "trust", "faith"], "axis", "value")
    return long.groupBy("axis").agg(r6(F.max("value") - F.min("value")).alias("spread")).where("spread < 0.5")


@query
def tfidf_long(s, d):
    t = b.brands(s, d, 10).select(F.col("account").alias("doc"), F.col("tag").alias("term"))
    return axes.tfidf(t, 3, 300).select("doc", "term", r6("value").alias("value"))


def _vectors(s, d):
    return axes.long_features(table(s, d, "embeddings"), "vec_id", F.col("embedding"), "label")


@query
def centered_features(s, d):
    return axes.centred(_vectors(s, d)).groupBy("vec_id").agg(r6(F.sum(F.col("value") * F.col("value"))).alias("norm2"))


@query
def cluster_projection(s, d):
    return axes.projection(_vectors(s, d), "label").select("label", F.col("dim").cast("long").alias("dim"), r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query
def eta_squared(s, d):
    return axes.eta_squared(_vectors(s, d), "label").select(F.col("dim").cast("long").alias("dim"), r6("eta2").alias("eta2"))


@query
def pc_minmax(s, d):
    means = axes.projection(_vectors(s, d), "label").where("dim < 2").groupBy("label").pivot("dim", [0, 1]).agg(F.first("mean"))
    return axes.min_max(means.select("label", F.col("0").alias("x"), F.col("1").alias("y")), ["x", "y"]).select("label", r6("x").alias("x"), r6("y").alias("y"))


@query
def spearman_axes(s, d):
    v = table(s, d, "embeddings").select("label", F.round(F.col("embedding")[0].cast("double"), 1).alias("x"), F.round(F.col("embedding")[1].cast("double"), 1).alias("y"))
    return axes.spearman(v, "x", "y", ["label"]).select("label", r6("r").alias("r"), "n")


@query
def pca_components(s, d):
    parts, explained = axes.pca(table(s, d, "embeddings"), "embedding", 8)
    rows = [(i + 1, float(explained[i]), float(explained[: i + 1].sum()), [float(x) for x in parts[i]]) for i in range(len(parts))]
    return s.createDataFrame(rows, "pc long, explained double, cumulative double, loadings array<double>")


@query
def local_pca(s, d):
    v = table(s, d, "embeddings").withColumn("sub", F.col("vec_id") % 3)
    return axes.local_pca(v, "label", "embedding", "sub")


# Communities


@query
def louvain_macro(s, d):
    return community.partition(b.edges(s, d).where("weight >= 3"))


@query
def louvain_recursive(s, d):
    return community.recursive_partition(b.edges(s, d).where("weight >= 3"), b.brands(s, d), depth=2).select("account", F.array_join("path", "·").alias("path"))


# Dial, memberships, text


@query
def dial_clusters(s, d):
    return views.alive(views.lifespans(b.tree(s)), b.dial(s)).groupBy("dial").agg(F.count(F.lit(1)).alias("alive"), F.count_if("robust").alias("robust"))


@query
def plateaus(s, d):
    return views.plateaus(b.tree(s)).withColumn("wide", F.col("width") >= 0.15)


@query
def dist_to_break(s, d):
    return views.distance_to_break(b.dial(s), b.tree(s))


@query
def scale_trace(s, d):
    spans = views.lifespans(b.tree(s))
    p = views.plateaus(b.tree(s)).select(F.col("lo"), ((F.col("lo") + F.col("hi")) / 2).alias("dial"))
    chain = s.createDataFrame([("x", n) for n in ("root", "a", "a1", "a11")] + [("y", n) for n in ("root", "c")], "account string, id string")
    seen = views.alive(spans, p).join(F.broadcast(chain), "id")
    return views.collapse(seen, "account", "lo", "id").select("account", "lo", "id")


def _soft(s, d):
    c = b.uses(s, d).join(b.accounts(s, d).select("account"), "account").groupBy("account", (F.col("sound") % 5).alias("block")).agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("account").agg(F.sum("n").alias("total"))
    return c.join(total, "account").select("account", "block", (F.col("n") / F.col("total")).alias("membership"))


@query
def soft_membership_rules(s, d):
    return views.membership_rules(_soft(s, d)).groupBy("state").agg(F.count(F.lit(1)).alias("accounts"), r6(F.avg("best")).alias("best"))


@query
def overlap_lens(s, d):
    m = _soft(s, d).where("membership >= 0.2").select(F.col("block").alias("tag"), "account")
    return graph.cooccurrence(m, 1, owner="tag", token="account").select(F.col("src").alias("left_block"), F.col("dst").alias("right_block"), F.col("weight").alias("shared"))


@query
def coupling_weights(s, d):
    m = b.members(s, d).select("account", F.col("cluster").alias("block"))
    return b.brands(s, d).join(m, "account").groupBy("block", "tag").agg(F.count(F.lit(1)).alias("weight"))


@query
def mode_detection(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", fn.query_mode(F.coalesce("text", F.lit("")), "en").alias("mode"))


@query
def header_stats(s, d):
    e = b.edges(s, d)
    nodes = graph.connected(b.accounts(s, d), e).agg(F.count(F.lit(1)).alias("nodes"), F.sum("followers").cast("long").alias("followers"))
    return nodes.join(F.broadcast(e.agg(F.count(F.lit(1)).alias("edges"))))  # one row each


@query
def enclosing_circles(s, d):
    """Centre of each cluster in a plane, and the radius that holds its members."""
    v = table(s, d, "embeddings").select("label", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    c = v.groupBy("label").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = F.max(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))) + 26
    return v.join(F.broadcast(c), "label").groupBy("label").agg(r6(F.first("cx")).alias("cx"), r6(F.first("cy")).alias("cy"), r6(far).alias("radius"))


# Sounds


def _sound_edges(s, d):
    return graph.sound_edges(b.titled_uses(s, d))


@query
def sound_cluster_sounds(s, d):
    return graph.sound_counts(_sound_edges(s, d), b.members(s, d, "macro"))


@query
def sound_lift(s, d):
    m = b.accounts(s, d).select("account", F.col("macro").alias("parent"), F.col("sub").alias("cluster"))
    return graph.sound_lift(_sound_edges(s, d), m).select("cluster", "sound", "cnt", "rank", r6("lift").alias("lift"))


@query
def sound_communities(s, d):
    return community.recursive_sounds(_sound_edges(s, d)).select("account", F.array_join("path", "·").alias("path"))


@query
def leiden_macro(s, d):
    return community.partition(b.edges(s, d).where("weight >= 3"), method="leiden")


# Discovery


def _valid(s, d):
    return discovery.valid_hits(b.hits(s, d), b.REJECT, 500, 9000)


def _known(s, d):
    return b.accounts(s, d).where("fully_collected").select(F.col("name").alias("username"))


@query
def valid_hits(s, d):
    return _valid(s, d).groupBy("signal").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("username").alias("accounts"))


@query
def chain_probe(s, d):
    return discovery.chain_probe(_valid(s, d), _known(s, d), b.SCOPE).select("signal", "abandoned", F.array_join("accounts", ",").alias("accounts"))


@query
def discovered_accounts(s, d):
    return discovery.discovered(_valid(s, d), _known(s, d), ["position", "signal"]).select("username", "signal", "position")


@query
def collection_outcomes(s, d):
    a, videos = b.accounts(s, d), table(s, d, "orders").select(F.col("o_custkey").alias("account")).distinct().withColumn("found", F.lit(True))
    known = F.when(F.col("account") % 2 == 0, F.col("followers")).otherwise(0)
    outcome = discovery.collection_outcome(known, F.col("found"), F.col("followers"), F.col("in_scope"), 1000)
    return a.join(videos, "account", "left").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("accounts"))


@query
def session_credits(s, d):
    cost = b.accounts(s, d).select("sub", "account", "followers", (2 + F.col("account") % 5).alias("credits"))
    return discovery.credits_left(cost, 100, ["sub"], ["account"]).groupBy("sub").agg(F.count(F.lit(1)).alias("accounts"), F.sum("credits").alias("credits"))


# Exports


@query
def node_export(s, d):
    m = b.members(s, d, "macro")
    valid = graph.validity(graph.density(b.edges(s, d), m)).where("valid")
    index = valid.withColumn("cluster_index", F.row_number().over(Window.orderBy(F.col("size").desc(), "cluster")).cast("long"))  # a row a cluster
    subs = b.accounts(s, d).select("account", F.lit(1).alias("depth"), F.col("sub").cast("string").alias("label"))
    t = b.brands(s, d)
    return exports.node_table(m, index, subs, graph.fit_scores(t, m, graph.cluster_tags(t, m)), graph.bridges(b.edges(s, d), m))


@query
def cluster_tree_json(s, d):
    rows = views.expand_paths(_paths(s, d)).groupBy(F.split("cluster_path", "·").alias("path")).agg(F.count(F.lit(1)).alias("size"), F.sum("followers").cast("long").alias("reach"))
    return exports.nested(rows, 3, ["reach"])


@query
def naming_requests(s, d):
    m = b.members(s, d)
    top = profiles.top_k(m, ["cluster"], [F.col("followers").desc(), F.col("account")], 6).groupBy("cluster").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "account"))), lambda x: x["account"].cast("string")).alias("accounts"))
    c = graph.density(b.edges(s, d), m).join(_top_lists(s, d, 8), "cluster").join(top, "cluster").withColumn("hints", F.array().cast("array<string>"))
    names = _top_lists(s, d, 8).where("cluster % 4 = 0").select(exports.name_key(F.col("tags")).alias("key"), F.lit("known").alias("name"))
    return exports.name_requests(c, names, "group")


@query
def rebuild_profiles(s, d):
    a = b.accounts(s, d).withColumn("tags", F.array("bio"))
    return profiles.rebuild(a, b.brand_uses(s, d), 5, 5).select("account", "rebuilt", F.array_join("tags", ",").alias("tags"))


@query
def publish_new_parts(s, d):
    o = table(s, d, "orders").join(b.accounts(s, d).select(F.col("account").alias("o_custkey"), "macro", "sub"), "o_custkey").select("o_orderdate", F.col("macro").alias("cluster"), F.concat_ws("-", "sub", F.date_format("o_orderdate", "MM")).alias("part"))
    split = F.lit(b.SPLIT).cast("timestamp_ntz")
    return views.new_parts(o.where((F.col("o_orderdate") < split) & (F.col("cluster") != 2) & ~F.col("part").endswith("07")), o.where(F.col("o_orderdate") >= split))


@query
def contract_rules(s, d):
    pairs = table(s, d, "nation").select(F.concat(F.lit("o"), "n_nationkey").alias("id"), F.array(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("n"), F.col("n_nationkey") + 1)).alias("between"))
    return views.contract_violations(b.blocks(s, d), pairs, 4)


# Components of tags


def _components(s, d):
    values = axes.tfidf(b.brands(s, d, 10).select(F.col("account").alias("doc"), F.col("tag").alias("term")), 3, 300)
    vectors, terms = axes.dense_terms(values)
    return values, axes.loadings(s, axes.pca(vectors, "vector", min(8, len(terms)))[0], terms)


@query
def pc_loadings(s, d):
    return axes.top_loadings(_components(s, d)[1], 5).select("pc", "side", "rank", "term", r6("loading").alias("loading"))


@query
def axis_correlations(s, d):
    """Rank correlation of each component of tags with each axis, over nations."""
    values, table_ = _components(s, d)
    at = axes.term_projection(values, table_).join(b.members(s, d).select(F.col("account").alias("doc"), "cluster"), "doc")
    means = at.groupBy("cluster", "pc").agg(F.avg("value").alias("mean"))
    return axes.axis_correlations(means, _axes(s, d).unpivot("cluster", ["political", "trust", "faith", "reach"], "axis", "score"))
