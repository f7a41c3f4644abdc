"""Hand-computed cases (FIXTURES.md) and invariants."""

import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shoal import functions as fn
from shoal.operators import axes, community, discovery, exports, graph, views
from shoal.operators.profiles import group_lift, tag_class
from shoal.sources import API_PROFILE, API_VIDEO, first_wins, json_document, latest, line_file, merge_accounts, normalise_profiles, normalise_videos, pages, with_version


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def tokens(spark, by):
    return rows(spark, [(a, t) for a, ts in by.items() for t in ts], "account string, tag string")


def test_three_signals_and_prune(spark):
    tags = tokens(spark, {"u1": "abcd", "u2": "abef", "u3": "a", "u5": "z"})
    words = tokens(spark, {"u1": ["w1", "w2"], "u2": ["w1"], "u3": ["w1", "w2"], "u4": ["w1", "w2"]})
    bios = tokens(spark, {"u1": ["x"], "u2": ["x"]})
    e = graph.combine(graph.cooccurrence(tags, 3), graph.cooccurrence(words, 1), graph.cooccurrence(bios, 2))
    assert {(r.src, r.dst): r.weight for r in e.collect()} == {("u1", "u2"): 9, ("u1", "u3"): 5, ("u2", "u3"): 4, ("u1", "u4"): 2, ("u2", "u4"): 1, ("u3", "u4"): 2}
    kept = graph.adaptive_prune(e, rows(spark, [("u3",), ("u4",), ("u5",)], "account string"))
    assert {(r.src, r.dst, r.weight) for r in kept.collect()} == {("u1", "u2", 9), ("u3", "u4", 2)}


def test_bio_multiset(spark):
    e = graph.bio_multiset(rows(spark, [("u1", "x"), ("u1", "x"), ("u2", "x")], "account string, tag string"))
    assert {(r.src, r.dst, r.weight) for r in e.collect()} == {("u1", "u2", 4), ("u1", "u1", 2)}


def test_lift(spark):
    data = [(i, t, "s", "p") for i in range(10) for t in (["t"] if i < 8 else []) + ["o"]] + [(100 + i, t, "r", "p") for i in range(20) for t in (["t"] if i < 2 else []) + ["o"]]
    out = group_lift(rows(spark, data, "account long, tag string, g string, p string"), "g", "p").where("g = 's' and tag = 't'").first()
    assert out.lift == pytest.approx(7.272727, abs=1e-6)


@pytest.mark.parametrize("n,density,top,depth,want", [(14, 0.4, 6.0, 1, 0.300), (14, 0.4, 6.0, 2, 0.255), (4, 1.0, 8.0, 1, 0.045), (5, 1.0, 8.0, 1, 0.091)])
def test_sub_confidence(spark, n, density, top, depth, want):
    assert value(spark, fn.sub_confidence(F.lit(n), F.lit(density), F.lit(top), F.lit(depth))) == pytest.approx(want, abs=6e-4)


@pytest.mark.parametrize("n,want", [(33, 0.5), (14, 0.12), (6, -0.04)])
def test_macro_confidence(spark, n, want):
    assert value(spark, fn.macro_confidence(F.lit(n), F.lit(0.2))) == pytest.approx(want)


def test_entropy_and_eta(spark):
    e = graph.entropy(rows(spark, [("g", "a", 2), ("g", "b", 2)], "g string, tag string, cnt long"), ["g"]).first()
    assert e.entropy == 1.0
    f = rows(spark, [(0, g, float(v)) for g, vs in (("x", (1, 2, 3)), ("y", (4, 5, 6))) for v in vs], "dim int, g string, value double")
    assert axes.eta_squared(f, "g").first().eta2 == pytest.approx(13.5 / 17.5)


def test_spearman_with_ties(spark):
    d = rows(spark, [("g", float(x), float(y)) for x, y in zip((1, 2, 2, 4), (1, 1, 3, 2))], "g string, x double, y double")
    assert axes.spearman(d, "x", "y", ["g"]).first().r == pytest.approx(0.5)


def test_strings(spark):
    assert value(spark, fn.fingerprint(F.array(*map(F.lit, ["delta", "alpha", "echo", "bravo", "charlie"])))) == "7b0ebf27"
    text = "Kijk #tag @user.name https://x.y/z Één mooie DAG, toch?"
    assert value(spark, fn.caption_words(F.lit(text))) == ["kijk", "name", "mooie", "toch"]
    assert value(spark, fn.path_prefixes(F.split(F.lit("1a·1·2"), "·"))) == ["1a", "1a·1", "1a·1·2"]
    assert value(spark, fn.url_username(F.lit("https://x.y/@ab.c/"))) == "ab.c"
    assert value(spark, fn.label_hint(F.array().cast("array<string>"))) == "unclear"
    assert [value(spark, tag_class(F.lit(c), F.lit(s), F.lit(g))) for c, s, g in ((0.4, True, True), (0.1, False, False), (0.1, True, True), (0.1, False, True))] == ["GENERAL", "NEW-DISCOVERY", "SEED", "DUTCH-KNOWN"]


@pytest.mark.parametrize("followers,novelty,want", [(1_000_000, 0.1, 26.28), (0, 0.5, 13.6), (100_000, 1.0, 25.0), (100_000, 0.5, 21.25)])
def test_frontier_score(spark, followers, novelty, want):
    assert value(spark, fn.frontier_score(F.lit(followers), F.lit(novelty))) == pytest.approx(want)


def test_normalised_difference_and_min_max(spark):
    assert value(spark, fn.normalised_difference(F.lit(3), F.lit(1))) == 0.5
    assert value(spark, fn.normalised_difference(F.lit(0), F.lit(0))) == 0.0
    assert axes.min_max(rows(spark, [(2.0,), (2.0,)], "v double"), ["v"]).first().v == 0.5


def test_tfidf(spark):
    t = rows(spark, [("d1", "a"), ("d1", "b"), ("d2", "a"), ("d3", "b"), ("d3", "c")], "doc string, term string")
    got = {(r.doc, r.term): round(r.value, 6) for r in axes.tfidf(t, 1, 10).collect()}
    assert got["d1", "a"] == got["d1", "b"] == 0.707107 and got["d3", "b"] == 0.605349 and got["d3", "c"] == 0.795961


def test_publish_diff(spark):
    old, new = rows(spark, [("A", 50), ("B", 20), ("C", 12)], "cluster string, size long"), rows(spark, [("A", 60), ("B", 25), ("D", 9)], "cluster string, size long")
    assert {r.cluster: r.change for r in views.publish_diff(old, new).collect()} == {"A": "changed", "B": "unchanged", "C": "disappeared", "D": "appeared"}


def test_dial_plateaus(spark):
    tree = rows(spark, [("r", None, 0.12)] + [(str(i), "r", x) for i, x in enumerate((0.40, 0.42, 0.45, 0.66, 0.68, 0.70))], "id string, parent string, split_at double")
    got = {(r.lo, r.hi) for r in views.plateaus(tree).where("width >= 0.15").collect()}
    assert got == {(0.12, 0.40), (0.45, 0.66), (0.70, 1.0)}


def _cliques():
    pair = lambda ns: [(a, b, 10.0) for a in ns for b in ns if a < b]
    return pair(range(6)) + pair(range(6, 12)) + [(5, 6, 6.0)]


def test_planted_communities(spark):
    e = rows(spark, [(a, b, int(w)) for a, b, w in _cliques()], "src long, dst long, weight long")
    for found in (community.partition(e), community.propagate(e)):
        groups = {}
        for r in found.collect():
            groups.setdefault(r.cluster, set()).add(r.account)
        assert sorted(map(sorted, groups.values())) == [list(range(6)), list(range(6, 12))]
    deep = community.recursive_partition(e, rows(spark, [(i, "t") for i in range(12)], "account long, tag string"), depth=2)
    assert deep.count() == 12


def _modularity(edges, part):
    m = sum(w for _, _, w in edges)
    deg, inner = {}, 0.0
    for a, b, w in edges:
        deg[part[a]] = deg.get(part[a], 0) + w
        deg[part[b]] = deg.get(part[b], 0) + w
        inner += w * (part[a] == part[b])
    return inner / m - sum((d / (2 * m)) ** 2 for d in deg.values())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda x: x[0] < x[1]), min_size=1))
def test_louvain_invariants(pairs):
    edges = [(a, b, 1.0) for a, b in sorted(pairs)]
    part = community.louvain(edges)
    assert set(part) == {n for p in pairs for n in p} and part == community.louvain(edges)
    assert _modularity(edges, part) >= -1e-9


def test_upserts(spark):
    r = rows(spark, [("k", 1, "a"), ("k", 2, "b"), (None, 3, "c")], "id string, seq int, v string")
    assert [x.v for x in latest(r, ["id"], ["seq"]).collect()] == ["b"]
    assert {x.v for x in first_wins(r, ["id"], ["seq"]).collect()} == {"a", "c"}
    cur, new = rows(spark, [("k", "old", True)], "id string, bio string, done boolean"), rows(spark, [("k", "new", False), ("n", "x", False)], "id string, bio string, done boolean")
    assert {(x.id, x.bio, x.done) for x in merge_accounts(cur, new, "id", ["done"]).collect()} == {("k", "new", True), ("n", "x", False)}


def test_sources(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# seeds\n one \n\ntwo\n")
    assert [r.value for r in line_file(spark, str(tmp_path / "seeds.txt")).collect()] == ["one", "two"]
    (tmp_path / "videos.json").write_text('[{"entityId": "", "id": "7", "content": "hi @a.b @a.b", "tag": [{"name": "x"}, {"name": ""}], "likeCount": 3}, {"content": "no id"}]')
    raw = json_document(spark, str(tmp_path / "videos.json"), API_VIDEO)
    assert json_document(spark, str(tmp_path / "none.json"), API_VIDEO).count() == 0
    v = normalise_videos(raw).collect()
    assert len(v) == 1 and v[0].video_id == "7" and v[0].hashtags == ["x"] and v[0].mentions == ["a.b"] and v[0].likes == 3 and v[0].views == 0


def test_stream_of_upserts(spark, tmp_path):
    from shoal.streaming import stream_latest

    rows(spark, [("k", 1, "a"), ("k", 2, "b")], "id string, seq int, v string").write.parquet(str(tmp_path / "in"))
    got = []
    q = stream_latest(spark.readStream.schema("id string, seq int, v string").parquet(str(tmp_path / "in")), ["id"], ["seq"], lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination()
    assert [r.v for r in got] == ["b"]


def test_leiden(spark):
    e = [(a, b, w) for a, b, w in _cliques()]
    part = community.leiden(e)
    assert {n: part[n] for n in range(12)} == {n: 0 if n < 6 else 6 for n in range(12)}
    df = rows(spark, [(a, b, int(w)) for a, b, w in e], "src long, dst long, weight long")
    assert {r.account: r.cluster for r in community.partition(df, method="leiden").collect()} == part


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 12), st.integers(0, 12)).filter(lambda x: x[0] < x[1]), min_size=1))
def test_leiden_communities_are_connected(pairs):
    edges = [(a, b, 1.0) for a, b in sorted(pairs)]
    part = community.leiden(edges)
    assert set(part) == {n for p in pairs for n in p} and _modularity(edges, part) >= -1e-9
    for c in set(part.values()):
        members = {n for n in part if part[n] == c}
        seen, todo = {min(members)}, [min(members)]
        while todo:
            v = todo.pop()
            for a, b, _ in edges:
                for x, y in ((a, b), (b, a)):
                    if x == v and y in members - seen:
                        seen.add(y)
                        todo.append(y)
        assert seen == members


def test_explained_entropy(spark):
    parts = rows(spark, [("p", c, a) for c, a in ((0, 1), (0, 2), (1, 3), (1, 4))], "p string, cluster long, account long")
    pure = rows(spark, [(1, "a"), (2, "a"), (3, "b"), (4, "b")], "account long, tag string")
    assert community.explained_entropy(parts, pure).first().ratio == pytest.approx(1.0)
    assert community.explained_entropy(parts, pure.replace("b", "a")).first().ratio == 0.0


def test_sounds(spark):
    uses = [(a, f"x{i}") for a in range(4) for i in range(3)] + [(a, f"y{i}") for a in range(4, 8) for i in range(2)] + [(3, "z"), (4, "z"), (0, "w"), (4, "w"), (9, "only")]
    e = graph.sound_edges(rows(spark, uses, "account long, sound string"), 1)
    m = rows(spark, [(a, "p", "l" if a < 4 else "r") for a in range(8)], "account long, parent string, cluster string")
    got = {(r.cluster, r.sound): (r.cnt, r.lift) for r in graph.sound_lift(e, m).collect()}
    assert got["l", "x0"] == (6, pytest.approx((6 / 4) / 0.01)) and ("l", "z") not in got and ("r", "y1") in got
    assert {r.sound for r in graph.sound_counts(e, m).where("cluster = 'r'").collect()} == {"y0", "y1"}
    strong = graph.sound_edges(rows(spark, uses, "account long, sound string"))
    paths = {r.account: r.path for r in community.recursive_sounds(strong).collect()}
    assert len({tuple(paths[a]) for a in range(4)}) == len({tuple(paths[a]) for a in range(4, 8)}) == 1 and paths[0] != paths[4]


@pytest.mark.parametrize("r,n", [(0.5, 3), (0.5, 4), (0.5, 5), (-0.3, 12), (0.8, 25), (0.1, 200), (1.0, 6)])
def test_p_of_correlation(spark, r, n):
    df, steps = n - 2, 200_000
    t = abs(r) * math.sqrt(df / max(1 - r * r, 1e-300))
    f = lambda x: (1 + x * x / df) ** (-(df + 1) / 2)
    u = lambda s: f(math.tan(s)) / math.cos(s) ** 2
    area = lambda hi: sum(u(hi * (i + 0.5) / steps) for i in range(steps)) * hi / steps
    assert value(spark, axes.student_p(F.lit(float(r)), F.lit(n))) == pytest.approx(1 - area(math.atan(t)) / area(math.pi / 2), abs=2e-5)


def test_discovery(spark):
    hits = rows(spark, [
        ("t", 1, "x_usa", "", "", 9000), ("t", 2, "tiny", "", "", 100), ("t", 3, "huge", "", "", 4_000_000), ("t", 4, "gate", "nl", "", 0), ("t", 5, "a", "", "", None), ("t", 6, "known", "", "", 6000),
        ("t", 7, "a", "", "", 6000), ("t", 8, "b", "", "", 6000), ("t", 9, "c", "", "", 6000), ("u", 1, "", "nl", "", 6000), ("u", 2, "d", "", "", 6000), ("u", 3, "e", "nl", "", 6000),
    ], "signal string, position long, username string, display_name string, bio string, followers long")
    known = rows(spark, [("known",)], "username string")
    valid = discovery.valid_hits(hits)
    assert {(r.signal, r.abandoned, tuple(r.accounts)) for r in discovery.chain_probe(valid, known, ["nl"]).collect()} == {("t", False, ("gate", "a", "b")), ("u", True, ())}
    assert {r.username for r in discovery.discovered(valid, known, ["signal", "position"]).collect()} == {"gate", "a", "b", "c", "d", "e"}
    out = lambda *a: value(spark, discovery.collection_outcome(*(F.lit(x) for x in a)))
    assert [out(100, True, 9000, True), out(0, None, 9000, True), out(0, True, 0, True), out(0, True, 9000, None), out(None, True, 9000, True)] == ["skipped", "unavailable", "too small", "out of scope", "collected"]
    left = discovery.credits_left(rows(spark, [("s", i, 4) for i in range(5)], "s string, i int, credits long"), 9, ["s"], ["i"])
    assert left.count() == 3


def test_exports(spark):
    tree = rows(spark, [(["a"], 5), (["a", "x"], 2), (["a", "y"], 3), (["b"], 1)], "path array<string>, size long")
    got = {r.id: json.loads(r.json) for r in exports.nested(tree, 2, []).collect()}
    assert [s["id"] for s in got["a"]["subclusters"]] == ["a·y", "a·x"] and got["b"] == {"id": "b", "size": 1, "subclusters": []}
    replies = ['```json\n{"name": "N", "description": "D"}\n```', '{"name": "N", "description": "D"}', "sorry"]
    assert [tuple(value(spark, exports.parse_reply(F.lit(x))) or ()) for x in replies][:2] == [("N", "D")] * 2
    assert value(spark, exports.parse_reply(F.lit("sorry")))["name"] is None
    c = rows(spark, [(1, 8, 0.5, ["b", "a"], ["u"], ["h"]), (2, 9, 0.5, ["c"], ["v"], [])], "cluster long, size long, density double, tags array<string>, accounts array<string>, hints array<string>")
    asked = exports.name_requests(c, rows(spark, [("c", "known"), ("a,b", "")], "key string, name string"), "group").collect()
    assert [r.cluster for r in asked] == [1] and "#b, #a" in asked[0].prompt and "parts: h" in asked[0].prompt and "50 %" in asked[0].prompt


def test_contract(spark):
    blocks = rows(spark, [("b1", 0, None, "account"), ("b1a", 1, "b1", "account"), ("b1b", 2, "b1", "content"), ("b2", 1, "gone", "account")], "id string, level int, parent string, kind string")
    overlaps = rows(spark, [("o1", ["b1", "b1a"]), ("o2", ["b1", "b1"]), ("o3", ["b1"]), ("o4", ["b1", "none"]), ("o5", None)], "id string, between array<string>")
    got = {(r.rule, r.id) for r in views.contract_violations(blocks, overlaps, 7).collect()}
    assert got == {("recommended level", "7"), ("parent exists", "b2"), ("parent of same kind", "b1b"), ("parent one level above", "b1b")} | {("overlap of two blocks", f"o{i}") for i in (2, 3, 4, 5)}


def test_query_mode(spark):
    mode = lambda t, lang="nl": value(spark, fn.query_mode(F.lit(t), lang))
    assert [mode("Bestaat dit"), mode("waar?"), mode("waar? of"), mode("zou er een bubbel zijn"), mode("but also this"), mode("but also this", "en")] == ["hypothesis", "hypothesis", "match", "hypothesis", "match", "hypothesis"]
    assert [value(spark, fn.original_sound(F.lit(t))) for t in ("Original Sound - x", "a hit", "Geluid van y")] == [True, False, True]


def test_pages_and_profiles(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"data": {"orderedItems": [{"preferredUsername": "a", "followerCount": 5}, {"name": "nobody"}], "nextCursor": "x"}}')
    (tmp_path / "p2.json").write_text('{"data": {"orderedItems": []}}')
    got = normalise_profiles(pages(spark, str(tmp_path), API_PROFILE)).collect()
    assert [tuple(r) for r in got] == [("a", "", 5, 0, "", False, 0)]


def test_versions(spark):
    v = rows(spark, [], "v long, date string, accounts long, changes array<string>")
    one = with_version(v, rows(spark, [(7,)], "accounts long"), ["first"], "2026-01-01")
    two = with_version(one, rows(spark, [(9,)], "accounts long"), ["A +10"], "2026-01-02")
    assert [(r.v, r.accounts) for r in two.orderBy("v").collect()] == [(1, 7), (2, 9)] and with_version(two, rows(spark, [(1,)], "accounts long"), [], "x").count() == 2


def test_large_groups_go_to_propagation(spark, monkeypatch):
    e = rows(spark, [(a, b, int(w), "big") for a, b, w in _cliques()] + [(20, 21, 1, "small")], "src long, dst long, weight long, g string")
    monkeypatch.setattr(community, "MAX_EDGES", 5)
    got = {(r.g, r.account): r.cluster for r in community.partition(e, "g").collect()}
    assert len(got) == 14 and got["small", 20] == got["small", 21] and len({got["big", i] for i in range(6)}) == 1 and got["big", 0] != got["big", 11]


def test_local_components_by_brute_force(spark):
    r = np.random.default_rng(3)
    x, label = r.normal(size=(30, 4)) * [4, 2, 1, 0.5], ["a"] * 10 + ["b"] * 12 + [None] * 8
    x[:10, 0] += 3
    data = [(1, g, v.tolist()) for g, v in zip(label, x)] + [(2, "a", [1.0, 2.0, 3.0, 4.0])] * 9 + [(3, g, [0.0] * 4) for g in "abcdefgh"] + [(None, "a", [0.0] * 4), (1, "a", None)]
    got = {(c.cluster, c.pc): (c.explained, c.eta2) for c in axes.local_pca(rows(spark, data, "c long, g string, v array<double>").repartition(5), "c", "v", "g").collect()}
    centred = x - x.mean(axis=0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    for i in range(4):
        at = (x[:22] - x[:22].mean(axis=0)) @ vt[i]
        total, between = (at**2).sum(), 10 * at[:10].mean() ** 2 + 12 * at[10:].mean() ** 2
        assert got[1, i + 1] == (pytest.approx(s[i] ** 2 / (s**2).sum()), pytest.approx(between / total, abs=6e-4))
    assert not any(c == 2 for c, _ in got) and {e for (c, _), e in got.items() if c == 3} == {(0.0, 0.0)}
