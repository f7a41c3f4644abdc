"""Communities by modularity: Louvain on bounded graphs, label propagation beyond the bound."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.functions import lift, sub_confidence
from shoal.operators._lineage import cut
from shoal.operators.graph import ends, entropy, sound_lift

#: Edges that one task takes; larger graphs are partitioned by label propagation.
MAX_EDGES = 3_000_000


def _adjacency(edges: list[tuple[int, int, float]]) -> tuple[list[int], list[dict[int, float]], list[float]]:
    """Nodes in order of id, the weights between them by position, and the weight of loops."""
    nodes = sorted({n for a, b, _ in edges for n in (a, b)})
    at = {n: i for i, n in enumerate(nodes)}
    links: list[dict[int, float]] = [defaultdict(float) for _ in nodes]
    own = [0.0] * len(nodes)
    for a, b, w in edges:
        if a == b:
            own[at[a]] += w
        else:
            links[at[a]][at[b]] += w
            links[at[b]][at[a]] += w
    return nodes, links, own


def _move(links: list[dict[int, float]], own: list[float], com: list[int]) -> list[int]:
    """Local moving: nodes go to the community around them of largest gain until none moves."""
    com, degree = com[:], [sum(x.values()) + 2 * o for x, o in zip(links, own)]
    total, weight = sum(degree), [0.0] * len(links)
    for v, c in enumerate(com):
        weight[c] += degree[v]
    moved, rounds = total > 0, 0
    while moved and rounds < 50:
        moved, rounds = False, rounds + 1
        for v in range(len(links)):
            near: dict[int, float] = defaultdict(float)
            for u, w in links[v].items():
                near[com[u]] += w
            weight[com[v]] -= degree[v]
            best, gain = com[v], near.get(com[v], 0.0) - weight[com[v]] * degree[v] / total
            for c in sorted(near):
                g = near[c] - weight[c] * degree[v] / total
                if g > gain + 1e-12:
                    best, gain = c, g
            weight[best] += degree[v]
            if best != com[v]:
                com[v], moved = best, True
    return com


def _merge(links: list[dict[int, float]], own: list[float], part: list[int], k: int) -> tuple[list[dict[int, float]], list[float]]:
    """The graph whose nodes are the ``k`` parts."""
    merged: list[dict[int, float]] = [defaultdict(float) for _ in range(k)]
    loops = [0.0] * k
    for v, x in enumerate(links):
        loops[part[v]] += own[v]
        for u, w in x.items():
            if part[u] == part[v]:
                loops[part[v]] += w / 2
            else:
                merged[part[v]][part[u]] += w
    return merged, loops


def _dense(part: list[int]) -> list[int]:
    names = {c: i for i, c in enumerate(sorted(set(part)))}
    return [names[c] for c in part]


def _named(nodes: list[int], part: list[int]) -> dict[int, int]:
    """Communities under the name of their least node."""
    least: dict[int, int] = {}
    for n, c in zip(nodes, part):
        least.setdefault(c, n)
    return {n: least[c] for n, c in zip(nodes, part)}


def louvain(edges: list[tuple[int, int, float]], max_passes: int = 20) -> dict[int, int]:
    """Two-phase modularity optimisation (Blondel et al., 2008), with fixed order and ties.

    Nodes are visited in order of id and go to the neighbouring community of largest
    gain, the smallest number on ties. Communities are named by their least node.
    """
    nodes, links, own = _adjacency(edges)
    part = list(range(len(nodes)))
    for _ in range(max_passes):
        com = _dense(_move(links, own, list(range(len(links)))))
        part, k = [com[p] for p in part], max(com, default=-1) + 1
        if k == len(links):
            break
        links, own = _merge(links, own, com, k)
    return _named(nodes, part)


def _refine(links: list[dict[int, float]], own: list[float], com: list[int]) -> list[int]:
    """Well-connected parts of each community, grown from single nodes by the largest gain."""
    degree = [sum(x.values()) + 2 * o for x, o in zip(links, own)]
    total, whole = sum(degree), [0.0] * len(links)
    inside = [sum(w for u, w in x.items() if com[u] == com[v]) for v, x in enumerate(links)]
    for v, c in enumerate(com):
        whole[c] += degree[v]
    part, weight, size, out = list(range(len(links))), degree[:], [1] * len(links), inside[:]
    for v in range(len(links)):
        if size[part[v]] > 1 or inside[v] < degree[v] * (whole[com[v]] - degree[v]) / total:
            continue
        near: dict[int, float] = defaultdict(float)
        for u, w in links[v].items():
            if com[u] == com[v]:
                near[part[u]] += w
        best, gain = part[v], 0.0
        for c in sorted(near):
            g = near[c] - weight[c] * degree[v] / total
            if g > gain + 1e-12 and out[c] >= weight[c] * (whole[com[v]] - weight[c]) / total - 1e-12:
                best, gain = c, g
        if best != part[v]:
            out[best] += inside[v] - 2 * near[best]
            size[part[v]], part[v] = 0, best
            weight[best], size[best] = weight[best] + degree[v], size[best] + 1
    return part


def leiden(edges: list[tuple[int, int, float]], max_passes: int = 20) -> dict[int, int]:
    """Louvain with refinement (Traag et al., 2019), in fixed order: every community is connected.

    A pass moves nodes, refines each community into well-connected parts, and goes on
    with the parts as nodes that start out in their community.
    """
    nodes, links, own = _adjacency(edges)
    first, at, com = links, list(range(len(nodes))), list(range(len(nodes)))
    for _ in range(max_passes):
        if not any(links) and not any(own):
            break
        com = _move(links, own, com)
        part = _dense(_refine(links, own, com))
        k = max(part) + 1
        if k == len(links):
            break
        start = [0] * k
        for v, c in enumerate(part):
            start[c] = com[v]
        links, own = _merge(links, own, part, k)
        at, com = [part[a] for a in at], _dense(start)
    final = [com[a] for a in at]
    seen, label = [-1] * len(nodes), 0  # where passes ran out, a community may still be in pieces
    for v in range(len(nodes)):
        if seen[v] < 0:
            todo, seen[v] = [v], label
            while todo:
                for u in first[todo.pop()]:
                    if seen[u] < 0 and final[u] == final[v]:
                        seen[u] = label
                        todo.append(u)
            label += 1
    return _named(nodes, seen)


METHODS = {"louvain": louvain, "leiden": leiden}


def partition(edges: DataFrame, by: str | None = None, method: str = "louvain") -> DataFrame:
    """(account, cluster) of the whole graph, or of each group ``by`` on its own (column kept).

    A group of more than MAX_EDGES edges goes to label propagation, so no task takes
    an unbounded one. An account is in one group.
    """
    find, key = METHODS[method], by or "whole_"
    rows = cut((edges if by else edges.withColumn(key, F.lit(0))).select(key, "src", "dst", "weight"))
    large = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_EDGES).select(key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = find(list(zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist())))
        return pd.DataFrame({key: pdf[key].iloc[0], "account": list(found), "cluster": list(found.values())}).astype({"account": "int64", "cluster": "int64"})

    schema = f"{key} {rows.schema[key].dataType.simpleString()}, account long, cluster long"
    if large.isEmpty():
        out = rows.groupBy(key).applyInPandas(run, schema)
    else:
        big = rows.join(large, key, "left_semi")
        group = big.select(key, F.explode(F.array("src", "dst")).alias("account")).distinct()
        far = group.join(propagate(big.select("src", "dst", "weight")), "account").select(key, "account", "cluster")
        out = rows.join(large, key, "left_anti").groupBy(key).applyInPandas(run, schema).unionByName(far)
    return out if by else out.drop(key)


def propagate(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Distributed label propagation: each account takes the heaviest label around it, least on ties."""
    both = ends(edges)
    labels = both.select("account").distinct().withColumn("cluster", F.col("account"))
    for _ in range(rounds):
        around = both.join(labels.select(F.col("account").alias("other"), "cluster"), "other")
        heard = around.groupBy("account", "cluster").agg(F.sum("weight").alias("w"))
        labels = heard.groupBy("account").agg(F.max(F.struct("w", (-F.col("cluster")).alias("c"))).alias("m")).select("account", (-F.col("m.c")).alias("cluster"))
        labels = cut(labels)
    return labels


def explained_entropy(parts: DataFrame, tags: DataFrame) -> DataFrame:
    """(p, ratio): how much of each parent's tag entropy its parts (p, cluster, account) explain."""
    t = parts.join(tags, "account")
    whole = entropy(t.groupBy("p", "tag").agg(F.count(F.lit(1)).alias("cnt")), ["p"]).select("p", F.col("entropy").alias("h"))
    inner = entropy(t.groupBy("p", "cluster", "tag").agg(F.count(F.lit(1)).alias("cnt")), ["p", "cluster"]).select("p", "cluster", "entropy")
    sizes = parts.groupBy("p", "cluster").agg(F.count(F.lit(1)).alias("size"))
    mean = sizes.join(inner, ["p", "cluster"], "left").groupBy("p").agg((F.sum(F.col("size") * F.coalesce("entropy", F.lit(0.0))) / F.sum("size")).alias("hi"))
    return whole.join(mean, "p").select("p", F.when(F.col("h") < 0.01, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("hi") / F.col("h"))).alias("ratio"))


def recursive_partition(edges: DataFrame, tags: DataFrame, depth: int = 8, least: int = 6, gates: bool = True) -> DataFrame:
    """(account, path): clusters split level by level until no part passes the gates.

    Level 0 is the whole-graph partition; each deeper level partitions the induced
    subgraphs of all clusters at once. A part needs size 3, density 0.10, a tag with
    lift over the level's threshold, and confidence 0.05; the split as a whole must explain
    a tenth of the parent's tag entropy (accounts without edges count as parts of their own).
    """
    edges, tags = cut(edges), cut(tags)
    level = cut(partition(edges).select("account", F.array(F.col("cluster").cast("string")).alias("path")))
    done = level
    for d in range(1, depth + 1):
        p = level.select("account", F.array_join("path", "/").alias("p"))
        inner = (
            edges.join(p.select(F.col("account").alias("src"), F.col("p")), "src").join(p.select(F.col("account").alias("dst"), F.col("p").alias("q")), "dst")
            .where("p = q").select("p", "src", "dst", "weight")
        )
        inner = cut(inner)
        sizes = p.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        parts = cut(partition(inner.join(sizes.select("p"), "p", "left_semi"), "p"))
        several = parts.groupBy("p").agg(F.countDistinct("cluster").alias("k")).where("k > 1").select("p")
        parts = parts.join(several, "p", "left_semi")
        if gates:
            size = parts.groupBy("p", "cluster").agg(F.count(F.lit(1)).alias("n"))
            m = parts.select("account", "cluster")
            e = (
                inner.join(m.select(F.col("account").alias("src"), "cluster"), "src").join(m.select(F.col("account").alias("dst"), F.col("cluster").alias("c2")), "dst")
                .where("cluster = c2").groupBy("p", "cluster").agg(F.count(F.lit(1)).alias("e"))
            )
            all_n = p.groupBy("p").agg(F.count(F.lit(1)).alias("n_all"))
            t_in = parts.join(tags, "account").groupBy("p", "cluster", "tag").agg(F.count(F.lit(1)).alias("c"))
            t_all = p.join(tags, "account").groupBy("p", "tag").agg(F.count(F.lit(1)).alias("c_all"))
            best = (
                t_in.join(t_all, ["p", "tag"]).join(size, ["p", "cluster"]).join(all_n, "p")
                .groupBy("p", "cluster").agg(F.max(lift(F.col("c"), F.col("n"), F.col("c_all") - F.col("c"), F.col("n_all") - F.col("n"))).alias("top"))
            )
            ratio = explained_entropy(p.join(parts.select("account", "cluster"), "account", "left").withColumn("cluster", F.coalesce("cluster", "account")), tags)
            n = F.col("n")
            good = size.join(e, ["p", "cluster"]).join(best, ["p", "cluster"]).withColumn("density", F.col("e") / (n * (n - 1) / 2))
            good = good.where((n >= 3) & (F.col("density") >= 0.10) & (F.col("top") >= 2.0 + 0.8 * (d - 1)) & (sub_confidence(n, F.col("density"), F.col("top"), F.lit(d)) >= 0.05))
            parts = parts.join(good.select("p", "cluster"), ["p", "cluster"], "left_semi").join(ratio.where("ratio >= 0.10"), "p", "left_semi")
        level = parts.select("account", F.split(F.concat_ws("/", "p", F.col("cluster").cast("string")), "/").alias("path"))
        level = cut(level)
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done.groupBy("account").agg(F.max_by("path", F.size("path")).alias("path"))


def recursive_sounds(edges: DataFrame, depth: int = 2, least: int = 3) -> DataFrame:
    """(account, path) of a sound graph (edges with their sounds): clusters split to ``depth`` levels.

    A part needs ``least`` accounts, density 0.10 and a sound among its ten commonest
    whose lift reaches 1 + the level.
    """
    edges = cut(edges)
    level = cut(partition(edges).select("account", F.array(F.col("cluster").cast("string")).alias("path")))
    done = level
    for d in range(1, depth + 1):
        p = level.select("account", F.array_join("path", "/").alias("parent"))
        inner = cut(
            edges.join(p.select(F.col("account").alias("src"), F.col("parent")), "src").join(p.select(F.col("account").alias("dst"), F.col("parent").alias("q")), "dst")
            .where("parent = q").select("parent", "src", "dst", "weight")
        )
        big = p.groupBy("parent").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2 * least)
        found = partition(inner.join(big, "parent", "left_semi"), "parent")
        members = cut(p.join(big, "parent", "left_semi").join(found.select("account", "cluster"), "account", "left").withColumn("cluster", F.coalesce("cluster", "account")))
        several = members.groupBy("parent").agg(F.countDistinct("cluster").alias("k")).where("k > 1")
        size = members.groupBy("parent", "cluster").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
        at = lambda end, c: members.select(F.col("account").alias(end), F.col("parent").alias(f"p_{end}"), F.col("cluster").alias(c))
        same = edges.join(at("src", "cluster"), "src").join(at("dst", "c2"), "dst").where("p_src = p_dst and cluster = c2")
        dense = same.groupBy(F.col("p_src").alias("parent"), "cluster").agg(F.count(F.lit(1)).alias("e")).join(size, ["parent", "cluster"]).where(F.col("e") / (F.col("n") * (F.col("n") - 1) / 2) >= 0.10)
        lifted = sound_lift(edges, members).where(F.col("lift") >= 1.0 + d)
        good = dense.join(lifted, ["parent", "cluster"], "left_semi").join(several, "parent", "left_semi")
        level = cut(members.join(good, ["parent", "cluster"], "left_semi").select("account", F.split(F.concat_ws("/", "parent", F.col("cluster").cast("string")), "/").alias("path")))
        if level.isEmpty():
            break
        done = done.unionByName(level)
    return done.groupBy("account").agg(F.max_by("path", F.size("path")).alias("path"))
