"""DuckDB SQL that gives the rows of each query from the same tables, written on its own."""

from __future__ import annotations

from shoal.functions import HYPOTHESIS_EN, HYPOTHESIS_NL, STOP_WORDS
from shoal.plans.bindings import DIAL, SPLIT, TREE

_ACC = """acc AS (
  SELECT c_custkey AS account, c_name AS name, CAST(floor(greatest(c_acctbal, 0)) AS BIGINT) AS followers, c_mktsegment AS bio, n_regionkey AS macro, c_nationkey AS sub,
    c_custkey % 3 <> 0 AS fully_collected, CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey % 4 <> 0 END AS in_scope
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_USES = """uses AS (
  SELECT o_custkey AS account, o_orderkey AS video, o_orderdate AS ts, l_partkey AS tag, l_suppkey AS sound
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_BUSES = "buses AS (SELECT account, video, ts, p_brand AS tag, sound FROM uses JOIN part ON tag = p_partkey)"
_TITLED = "titled AS (SELECT account, video, ts, CAST(sound AS VARCHAR) || '-' || strftime(ts, '%Y%m') AS sound FROM uses)"
_SEDGES = """u AS (SELECT DISTINCT account, sound FROM titled),
spairs AS (SELECT x.account AS src, y.account AS dst, sound FROM u x JOIN u y USING (sound) WHERE x.account < y.account),
sedges AS (SELECT src, dst, count(*) AS weight FROM spairs GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _top(source: str, name: str, k: int, tag: str = "tag") -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT account, {tag} AS tag, count(*) AS cnt, row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, {tag}) AS rank
    FROM {source} GROUP BY account, {tag}) WHERE rank <= {k})"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


_TAGS = _top("uses", "tags", 50)
_BRANDS = _top("buses", "brands", 5)
_PAIRS = "pairs AS (SELECT x.account AS src, y.account AS dst, count(*) AS shared FROM tags x JOIN tags y ON x.tag = y.tag AND x.account < y.account GROUP BY 1, 2)"
_EDGES = "edges AS (SELECT src, dst, shared AS weight FROM pairs WHERE shared >= 2)"
_GRAPH = (_ACC, _USES, _TAGS, _PAIRS, _EDGES)
_ENDS = "ends AS (SELECT src AS account, dst AS other, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)"
_SIGNALS = (
    _ACC, _USES, _TAGS, _top("uses", "sounds", 5, "sound"), "bios AS (SELECT account, concat_ws('-', bio, account % 97) AS tag FROM acc)", _PAIRS,
    """signals AS (SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM (
    SELECT src, dst, shared * 3 AS weight FROM pairs
    UNION ALL SELECT x.account, y.account, 1 FROM sounds x JOIN sounds y ON x.tag = y.tag AND x.account < y.account
    UNION ALL SELECT x.account, y.account, 2 FROM bios x JOIN bios y ON x.tag = y.tag AND x.account < y.account) GROUP BY 1, 2)""",
    "sparse AS (SELECT account FROM tags GROUP BY account HAVING count(*) <= 20)",
)


def _pruned(weak: int, strong: int) -> str:
    return f"""pruned AS (SELECT * FROM signals WHERE weight >= CASE WHEN src IN (SELECT account FROM sparse) AND dst IN (SELECT account FROM sparse) THEN {weak} ELSE {strong} END)"""


def _density(level: str) -> str:
    return f"""dens AS (
  SELECT s.cluster, s.size, coalesce(e.edges, 0) AS edges, CASE WHEN s.size < 2 THEN 0.0 ELSE coalesce(e.edges, 0) / (s.size * (s.size - 1) / 2.0) END AS density
  FROM (SELECT {level} AS cluster, count(*) AS size FROM acc GROUP BY 1) s
  LEFT JOIN (SELECT x.{level} AS cluster, count(*) AS edges FROM edges JOIN acc x ON src = x.account JOIN acc y ON dst = y.account WHERE x.{level} = y.{level} GROUP BY 1) e USING (cluster))"""


_BRIDGES = """bridges AS (SELECT * FROM (
  SELECT x.sub AS cluster, e.account, count(DISTINCT e.other) AS external, row_number() OVER (PARTITION BY x.sub ORDER BY count(DISTINCT e.other) DESC, e.account) AS rank
  FROM ends e JOIN acc x ON e.account = x.account JOIN acc y ON e.other = y.account WHERE x.sub <> y.sub GROUP BY 1, 2) WHERE rank <= 3)"""


def _ctags(level: str, k: int = 10) -> str:
    return f"""ctags AS (SELECT * FROM (
  SELECT {level} AS cluster, tag, count(*) AS cnt, row_number() OVER (PARTITION BY {level} ORDER BY count(*) DESC, tag) AS rank FROM brands JOIN acc USING (account) GROUP BY 1, 2) WHERE rank <= {k})"""


_FIT = """fit AS (SELECT account, sub AS cluster, coalesce((SELECT count(*) FROM brands t JOIN ctags c ON t.tag = c.tag WHERE t.account = acc.account AND c.cluster = acc.sub)
  / CAST((SELECT count(*) FROM ctags c WHERE c.cluster = acc.sub) AS DOUBLE), 0) AS fit FROM acc)"""
_BR = (_ACC, _USES, _BUSES, _BRANDS)
_LIFT = """atag AS (SELECT account, tag, macro, sub FROM brands JOIN acc USING (account)),
sizes AS (SELECT macro, sub, count(DISTINCT account) AS n FROM atag GROUP BY 1, 2),
lifts AS (SELECT a.sub, a.tag, a.c AS c_in, (a.c / CAST(s.n AS DOUBLE)) / ((p.c - a.c) / CAST(greatest(pn.n - s.n, 1) AS DOUBLE) + 0.01) AS lift
  FROM (SELECT macro, sub, tag, count(*) AS c FROM atag GROUP BY 1, 2, 3) a JOIN (SELECT macro, tag, count(*) AS c FROM atag GROUP BY 1, 2) p USING (macro, tag)
  JOIN sizes s USING (macro, sub) JOIN (SELECT macro, CAST(sum(n) AS BIGINT) AS n FROM sizes GROUP BY 1) pn USING (macro))"""
_AXES = """lex(side, lo) AS (VALUES ('left', 1), ('right', 2), ('trust', 3), ('distrust', 4), ('faith', 5)),
sided AS (SELECT sub AS cluster, side FROM brands JOIN acc USING (account) LEFT JOIN lex ON tag[7] = CAST(lo AS VARCHAR) AND tag[8] BETWEEN '1' AND '5'),
cnt AS (SELECT cluster, count(*) AS tags, count(*) FILTER (side = 'left') AS l, count(*) FILTER (side = 'right') AS r, count(*) FILTER (side = 'trust') AS t, count(*) FILTER (side = 'distrust') AS u, count(*) FILTER (side = 'faith') AS f FROM sided GROUP BY 1),
axes AS (SELECT cluster, tags, CASE WHEN l + r = 0 THEN 0.0 ELSE (r - l) / CAST(l + r AS DOUBLE) END AS political, CASE WHEN t + u = 0 THEN 0.0 ELSE (t - u) / CAST(t + u AS DOUBLE) END AS trust,
  f / CAST(tags AS DOUBLE) AS faith, (SELECT ln(1 + sum(followers)) FROM acc WHERE sub = cluster) AS reach FROM cnt)"""
_VEC = "vec AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
_TREE = "tree(id, parent, split_at) AS (VALUES " + ", ".join(f"('{i}', {'NULL' if p is None else repr(p)}, CAST({x} AS DOUBLE))" for i, p, x in TREE) + ")"
_DIAL = "dial(dial) AS (VALUES " + ", ".join(f"(CAST({x} AS DOUBLE))" for x in DIAL) + ")"
_SPANS = "spans AS (SELECT t.id, CASE WHEN p.split_at IS NULL THEN 0.0 ELSE least(p.split_at, 1.0) END AS born, least(t.split_at, 1.0) AS dies FROM tree t LEFT JOIN tree p ON t.parent = p.id)"
_PLAT = "plat AS (SELECT * FROM (SELECT b AS lo, lead(b) OVER (ORDER BY b) AS hi FROM (SELECT split_at AS b FROM tree WHERE split_at < 1 UNION SELECT 0.0 UNION SELECT 1.0)) WHERE hi IS NOT NULL)"
_CONF = "CASE WHEN confidence >= 0.6 THEN 'HIGH' WHEN confidence >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS label"
_SOFT = "soft AS (SELECT account, sound % 5 AS block, count(*) / CAST(sum(count(*)) OVER (PARTITION BY account) AS DOUBLE) AS membership FROM uses JOIN acc USING (account) GROUP BY 1, 2)"
_WORDS = r"[^\p{L}\p{N}_\s]"

ORACLE_SQL = {
    "table_stats": "SELECT 'accounts' AS name, count(*) AS n FROM customer UNION ALL SELECT 'videos', count(*) FROM orders UNION ALL SELECT 'tags', count(*) FROM lineitem",
    "snapshot_stats": _with(_ACC) + "SELECT count(*) AS accounts, count(*) FILTER (fully_collected) AS collected, count(*) FILTER (fully_collected AND in_scope) AS in_scope, CAST(sum(followers) AS BIGINT) AS followers FROM acc",
    "latest_upsert": "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "first_wins_dedup": "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1",
    "flag_update": _with(_ACC) + "SELECT bio = 'BUILDING' OR fully_collected AS fully_collected, coalesce(CAST(CASE WHEN bio = 'BUILDING' THEN false ELSE in_scope END AS VARCHAR), 'unknown') AS scope, count(*) AS n FROM acc GROUP BY 1, 2",
    "in_scope_filter": _with(_ACC) + "SELECT account, followers FROM acc WHERE fully_collected AND in_scope",
    "json_tags": "SELECT user_id, CAST(sum(CASE WHEN event_id % 7 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS tags FROM events GROUP BY 1",
    "url_username": r"SELECT page_id, CASE WHEN (n <> '' AND NOT contains(n, '.')) OR length(n) > 2 THEN n END AS username FROM (SELECT page_id, ltrim(split_part(rtrim(url, '/'), '/', -1), '@') AS n FROM pages)",
    "snapshot_append": "SELECT strftime(ts, '%Y-%m-%d') AS snapshot, count(*) AS events, count(DISTINCT user_id) AS accounts FROM events GROUP BY 1",
    "account_tag_profile_topk": _with(_USES, _TAGS) + "SELECT account, tag, cnt, rank FROM tags",
    "account_tag_profile_k20": _with(_USES, _BUSES, _top("buses", "b20", 20)) + "SELECT account, tag, cnt, rank FROM b20",
    "profile_fallback_join": _with(*_BR) + "SELECT account, coalesce((SELECT string_agg(tag, ',' ORDER BY tag) FROM brands t WHERE t.account = acc.account), bio) AS tags FROM acc",
    "caption_keywords_topk": _with(
        rf"words AS (SELECT source AS account, unnest(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '#[\p{{L}}\p{{N}}_]+', '', 'g'), '@[\p{{L}}\p{{N}}_]+', '', 'g'), 'https?://\S+', '', 'g'), '{_WORDS}', ' ', 'g'), '\s+')) AS w FROM documents)",
        "kept AS (SELECT account, lower(w) AS tag FROM words WHERE length(w) >= 4 AND lower(w) NOT IN " + str(STOP_WORDS) + ")", _top("kept", "k30", 30),
    ) + "SELECT account, tag, cnt, rank FROM k30",
    "bio_tokens_multiset": _with(_ACC, "m AS (SELECT account, tag, count(*) AS m FROM (SELECT account, concat_ws('-', bio, account % 97) AS tag FROM acc UNION ALL SELECT account, CASE WHEN account % 3 = 0 THEN concat_ws('-', bio, account % 97) ELSE CAST(account AS VARCHAR) END FROM acc) GROUP BY 1, 2)",
        "e AS (SELECT x.account AS src, y.account AS dst, 2 * sum(CASE WHEN x.account = y.account THEN x.m * (x.m - 1) // 2 ELSE x.m * y.m END) AS weight FROM m x JOIN m y ON x.tag = y.tag AND x.account <= y.account GROUP BY 1, 2)")
        + "SELECT src = dst AS loop, count(*) AS edges, CAST(sum(weight) AS BIGINT) AS weight FROM e WHERE weight > 0 GROUP BY 1",
    "mentions_extract": r"SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '@([\p{L}\p{N}_.]+)', 1))) AS mention FROM documents",
    "mentions_frequent": r"SELECT source, mention, cnt FROM (SELECT source, mention, count(*) AS cnt, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, mention) AS rank FROM (SELECT source, unnest(regexp_extract_all(text, '@([\p{L}\p{N}_.]+)', 1)) AS mention FROM documents) WHERE length(mention) > 2 GROUP BY 1, 2) WHERE rank <= 10 AND cnt >= 2",
    "language_share_scope": "SELECT source, round(avg(CASE WHEN lang = 'de' THEN 1.0 ELSE 0.0 END), 6) AS share, round(avg(CASE WHEN lang = 'de' THEN 1.0 ELSE 0.0 END), 6) >= 0.2 AS scope FROM documents WHERE lang IS NOT NULL GROUP BY 1",
    "scope_classifier": _with(*_BR) + """SELECT account, CAST(CASE WHEN share >= 0.2 THEN 0 WHEN contains(lower(bio || ' ' || name), 'mach') OR contains(lower(bio || ' ' || name), 'house') THEN 1
        WHEN account IN (SELECT account FROM brands WHERE tag IN ('Brand#11', 'Brand#55')) THEN 2 ELSE -1 END AS BIGINT) AS tier
        FROM acc LEFT JOIN (SELECT account, avg(CASE WHEN sound % 5 = 0 THEN 1.0 ELSE 0.0 END) AS share FROM uses GROUP BY 1) USING (account)""",
    "corpus_tag_counts": _with(_USES, _TAGS) + "SELECT tag, count(*) AS accounts FROM tags GROUP BY 1",
    "first_k_distinct": "SELECT user_id, event_type, rank FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rank FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1)) WHERE rank <= 3",
    "chain_signals": _with(_USES, _top("uses", "t20", 20), "corpus AS (SELECT tag, count(*) AS corpus FROM t20 GROUP BY 1)") + """SELECT account, tag, cnt, corpus, round(score, 6) AS score FROM (
        SELECT account, tag, cnt, coalesce(corpus, 0) AS corpus, cnt / CAST(coalesce(corpus, 0) + 1 AS DOUBLE) AS score FROM (SELECT account, tag, count(*) AS cnt FROM uses GROUP BY 1, 2) LEFT JOIN corpus USING (tag))
        WHERE corpus < 30 AND cnt >= 2 QUALIFY row_number() OVER (PARTITION BY account ORDER BY score DESC, tag) <= 3""",
    "tag_tracker": _with(_USES) + "SELECT tag, count(*) AS mentions, count(DISTINCT account) AS unique_accounts, round(100.0 * count(DISTINCT account) / (SELECT count(*) FROM customer), 1) AS coverage_pct FROM uses GROUP BY 1 HAVING count(*) >= 3",
    "tag_classes": _with(_USES, _BUSES) + """SELECT tag, accounts, CASE WHEN share > 0.3 THEN 'GENERAL' WHEN tag NOT IN ('Brand#11', 'Brand#23') AND NOT contains(tag, '#5') THEN 'NEW-DISCOVERY' WHEN tag IN ('Brand#11', 'Brand#23') THEN 'SEED' ELSE 'DUTCH-KNOWN' END AS class
        FROM (SELECT tag, count(DISTINCT account) AS accounts, count(DISTINCT account) / CAST((SELECT count(*) FROM customer) AS DOUBLE) - 0.4 AS share FROM buses GROUP BY 1)""",
    "seed_activity": _with(_USES) + "SELECT count(*) AS seeds, count(*) FILTER (mentions >= 30) AS active FROM (SELECT p_partkey AS tag FROM part WHERE p_partkey <= 60) LEFT JOIN (SELECT tag, count(*) AS mentions FROM uses GROUP BY 1) USING (tag)",
    "discovery_novelty": _with(_USES, _TITLED, f"o AS (SELECT DISTINCT sound FROM titled WHERE ts < TIMESTAMP '{SPLIT}')", f"n AS (SELECT DISTINCT sound FROM titled WHERE ts >= TIMESTAMP '{SPLIT}')",
        "c AS (SELECT (SELECT count(*) FROM (FROM n EXCEPT FROM o)) AS fresh, (SELECT count(*) FROM (FROM n INTERSECT FROM o)) AS repeated, (SELECT count(*) FROM (FROM o EXCEPT FROM n)) AS gone)")
        + "SELECT *, CASE WHEN novel_pct >= 50 THEN 'LOW' WHEN novel_pct >= 20 THEN 'MODERATE' ELSE 'HIGH' END AS saturation FROM (SELECT *, round(100.0 * fresh / greatest(fresh + repeated, 1), 1) AS novel_pct FROM c)",
    "cooccurrence_edges": _with(_USES, _TAGS, _PAIRS) + "SELECT src, dst, shared * 3 AS weight FROM pairs WHERE shared >= 2",
    "top_edges": _with(_USES, _TAGS, _PAIRS) + "SELECT src, dst, shared AS weight FROM pairs WHERE shared >= 2 ORDER BY weight DESC, src, dst LIMIT 100",
    "multi_signal_edges": _with(*_SIGNALS) + "SELECT * FROM signals WHERE weight >= 4",
    "adaptive_prune": _with(*_SIGNALS, _pruned(4, 7)) + "SELECT * FROM pruned",
    "connected_nodes": _with(*_SIGNALS, _pruned(4, 9)) + "SELECT account, followers FROM acc WHERE account IN (SELECT src FROM pruned UNION SELECT dst FROM pruned)",
    "node_degree": _with(*_GRAPH, _ENDS) + "SELECT account, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM ends GROUP BY 1",
    "sound_stats": _with(_ACC, _USES) + "SELECT sound, s_name AS title, count(*) AS uses, count(DISTINCT account) AS accounts FROM uses JOIN acc USING (account) JOIN supplier ON sound = s_suppkey WHERE fully_collected AND in_scope GROUP BY 1, 2",
    "sound_originals_split": _with(_ACC, _USES, "st AS (SELECT sound, s_name AS title, count(DISTINCT account) AS accounts FROM uses JOIN acc USING (account) JOIN supplier ON sound = s_suppkey WHERE fully_collected AND in_scope GROUP BY 1, 2)")
        + "SELECT * FROM (SELECT regexp_matches(title, '[02468]$') AS original, sound, accounts, row_number() OVER (PARTITION BY regexp_matches(title, '[02468]$') ORDER BY accounts DESC, sound) AS rank FROM st) WHERE rank <= 20",
    "sound_edges": _with(_USES, _TITLED, _SEDGES) + "SELECT src, dst, weight, string_agg(sound, ',' ORDER BY sound) AS sounds FROM spairs JOIN sedges USING (src, dst) GROUP BY 1, 2, 3",
    "sound_vs_tag_jaccard": _with(_ACC, _USES, "u AS (SELECT DISTINCT sound AS l, account FROM uses)") + """SELECT l, sub AS r, count(*) AS "both", round(count(*) / CAST((SELECT count(*) FROM u v WHERE v.l = u.l) + (SELECT count(*) FROM acc b WHERE b.sub = acc.sub) - count(*) AS DOUBLE), 6) AS jaccard FROM u JOIN acc USING (account) GROUP BY l, sub""",
    "tag_tag_cooccurrence": _with(_USES, _BUSES, "t AS (SELECT DISTINCT video, tag FROM buses)") + "SELECT x.tag AS src, y.tag AS dst, count(*) AS weight FROM t x JOIN t y ON x.video = y.video AND x.tag < y.tag GROUP BY 1, 2",
    "df_band_filter": _with(_USES) + "SELECT tag, count(DISTINCT account) AS accounts FROM uses GROUP BY 1 HAVING count(DISTINCT account) >= 3 AND count(DISTINCT account) <= 0.4 * (SELECT count(*) FROM customer)",
    "cluster_density": _with(*_GRAPH, _density("sub")) + "SELECT cluster, size, edges, round(density, 6) AS density, size >= 8 AND density >= 0.03 AS valid FROM dens",
    "cluster_reach": _with(_ACC) + "SELECT sub AS cluster, CAST(sum(followers) AS BIGINT) AS reach FROM acc GROUP BY 1",
    "cluster_top_accounts": _with(_ACC) + "SELECT * FROM (SELECT sub AS cluster, account, row_number() OVER (PARTITION BY sub ORDER BY followers DESC, account) AS rank FROM acc) WHERE rank <= 10",
    "cluster_index": _with(_ACC) + "SELECT sub AS cluster, count(*) AS size, row_number() OVER (ORDER BY count(*) DESC, sub) AS cluster_index FROM acc GROUP BY 1",
    "cluster_top_tags": _with(*_BR, _ctags("sub")) + "SELECT cluster, tag, cnt, rank FROM ctags",
    "cluster_bridges": _with(*_GRAPH, _ENDS, _BRIDGES) + "SELECT cluster, account, external, rank FROM bridges",
    "fit_scores": _with(*_BR, _ctags("sub"), _FIT) + "SELECT account, cluster, round(fit, 6) AS fit FROM fit",
    "mean_fit": _with(*_BR, _ctags("sub"), _FIT) + "SELECT cluster, round(avg(fit) + 1e-9, 6) AS mean_fit FROM fit GROUP BY 1",
    "outliers": _with(*_BR, _ctags("sub"), _FIT) + "SELECT * FROM (SELECT cluster, account, round(fit, 6) AS fit, row_number() OVER (PARTITION BY cluster ORDER BY fit.fit, account) AS rank FROM fit WHERE fit < 0.15) WHERE rank <= 4",
    "cross_affinity": _with(*_BR, _ctags("macro")) + """SELECT account, cluster, other, round(affinity, 6) AS affinity FROM (
        SELECT t.account, acc.macro AS cluster, c.cluster AS other, count(*) / CAST((SELECT count(*) FROM ctags k WHERE k.cluster = c.cluster) AS DOUBLE) AS affinity
        FROM brands t JOIN acc ON t.account = acc.account JOIN ctags c ON t.tag = c.tag AND c.cluster <> acc.macro GROUP BY t.account, acc.macro, c.cluster) WHERE affinity > 0.05 QUALIFY row_number() OVER (PARTITION BY account ORDER BY affinity DESC, other) = 1""",
    "lift": _with(*_BR, _LIFT) + "SELECT sub, tag, c_in, round(lift, 6) AS lift FROM lifts",
    "distinctive_tags": _with(*_BR, _LIFT) + "SELECT sub, string_agg('#' || tag, ' / ' ORDER BY rank) AS hint FROM (SELECT sub, tag, row_number() OVER (PARTITION BY sub ORDER BY round(lift, 6) DESC, tag) AS rank FROM lifts WHERE lift >= 1.2) WHERE rank <= 3 GROUP BY 1",
    "tag_entropy": _with(*_BR) + "SELECT macro, round(-sum(p * log2(p)), 6) AS entropy FROM (SELECT macro, count(*) / CAST(sum(count(*)) OVER (PARTITION BY macro) AS DOUBLE) AS p FROM brands JOIN acc USING (account) GROUP BY macro, tag) GROUP BY 1",
    "variance_ratio": _with(*_BR, "h AS (SELECT macro, -sum(p * log2(p)) AS h FROM (SELECT macro, count(*) / CAST(sum(count(*)) OVER (PARTITION BY macro) AS DOUBLE) AS p FROM brands JOIN acc USING (account) GROUP BY macro, tag) GROUP BY 1)",
        "hs AS (SELECT macro, sub, -sum(p * log2(p)) AS h FROM (SELECT macro, sub, count(*) / CAST(sum(count(*)) OVER (PARTITION BY macro, sub) AS DOUBLE) AS p FROM brands JOIN acc USING (account) GROUP BY macro, sub, tag) GROUP BY 1, 2)")
        + "SELECT macro, round(CASE WHEN any_value(h.h) < 0.01 THEN 0.0 ELSE greatest(0.0, 1 - sum(n * hs.h) / sum(n) / any_value(h.h)) END, 6) AS ratio FROM hs JOIN (SELECT macro, sub, count(*) AS n FROM acc GROUP BY 1, 2) USING (macro, sub) JOIN h USING (macro) GROUP BY 1",
    "macro_confidence": _with(*_GRAPH, _density("macro")) + f"SELECT *, {_CONF} FROM (SELECT cluster, round(least(1.0, (size - 8) / 25.0) * least(1.0, density / 0.4), 3) AS confidence FROM dens)",
    "sub_confidence": _with(_ACC, _USES, _BUSES, _BRANDS, _TAGS, _PAIRS, _EDGES, _density("sub"), _LIFT)
        + f"SELECT *, {_CONF} FROM (SELECT cluster, round(least(1.0, (size - 3) / 22.0) * least(1.0, density / 0.5) * least(1.0, top / 8), 3) AS confidence FROM dens JOIN (SELECT sub AS cluster, max(lift) AS top FROM lifts GROUP BY 1) USING (cluster))",
    "cluster_fingerprint": _with(*_BR, _ctags("sub", 5)) + "SELECT cluster, substring(md5(string_agg(tag, ',' ORDER BY tag)), 1, 8) AS fingerprint FROM ctags GROUP BY 1",
    "fingerprint_name_match": _with(*_BR, _ctags("sub"), "names(name, fp) AS (VALUES ('north', ['Brand#11', 'Brand#12', 'Brand#13']), ('south', ['Brand#21', 'Brand#55']), ('east', ['Brand#33', 'Brand#34']))")
        + "SELECT cluster, name, score FROM (SELECT cluster, name, fp, count(*) AS score FROM ctags JOIN names ON list_contains(fp, tag) GROUP BY 1, 2, 3) WHERE score >= greatest(1, len(fp) - 1) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY score DESC, name) = 1",
    "cluster_summary": _with(_ACC, _USES, _BUSES, _BRANDS, _TAGS, _PAIRS, _EDGES, _ENDS, _BRIDGES, _ctags("sub", 8))
        + "SELECT cluster, tags, coalesce(b, '') AS bridges FROM (SELECT cluster, string_agg(tag, ',' ORDER BY rank) AS tags FROM ctags GROUP BY 1) LEFT JOIN (SELECT cluster, string_agg(CAST(account AS VARCHAR), ',' ORDER BY rank) AS b FROM bridges GROUP BY 1) USING (cluster)",
    "publish_diff": _with(_ACC, "o AS (SELECT sub AS cluster, o_orderdate AS ts FROM orders JOIN acc ON o_custkey = account)",
        f"a AS (SELECT cluster, count(*) AS old_size FROM o WHERE ts < TIMESTAMP '{SPLIT}' AND cluster <> 3 GROUP BY 1)", f"n AS (SELECT cluster, count(*) AS new_size FROM o WHERE ts >= TIMESTAMP '{SPLIT}' AND cluster <> 7 GROUP BY 1)")
        + "SELECT cluster, old_size, new_size, CASE WHEN old_size IS NULL THEN 'appeared' WHEN new_size IS NULL THEN 'disappeared' WHEN abs(new_size - old_size) >= 10 THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN n USING (cluster)",
    "path_labels": "SELECT n_nationkey, CAST(n_regionkey + 1 AS VARCHAR) || chr(CAST(96 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INTEGER)) AS label FROM nation",
    "path_prefix_members": _with(_ACC) + "SELECT concat_ws('·', macro, sub, bio) AS path, count(*) AS members, CAST(sum(followers) AS BIGINT) AS reach FROM acc GROUP BY GROUPING SETS ((macro), (macro, sub), (macro, sub, bio))",
    "account_memberships": _with(_ACC) + "SELECT account, macro || ' > ' || macro || '·' || sub || ' > ' || macro || '·' || sub || '·' || bio AS paths FROM acc",
    "descendant_count": _with(_ACC) + "SELECT CAST(macro AS VARCHAR) AS path, count(DISTINCT sub) + count(DISTINCT (sub, bio)) AS descendants FROM acc GROUP BY macro UNION ALL SELECT macro || '·' || sub, count(DISTINCT bio) FROM acc GROUP BY macro, sub",
    "frontier_by_followers": _with(_ACC) + "SELECT account, followers FROM acc WHERE NOT fully_collected ORDER BY followers DESC, account LIMIT 200",
    "frontier_scored": _with(_ACC, _USES, _top("uses", "t20", 20), "common AS (SELECT tag FROM t20 GROUP BY tag ORDER BY count(*) DESC, tag LIMIT 300)",
        "nov AS (SELECT account, avg(CASE WHEN tag IN (SELECT tag FROM common) THEN 0.0 ELSE 1.0 END) AS novelty FROM t20 GROUP BY 1)")
        + """SELECT account, account % 50 = 1 AS priority, round(power(log10(CASE WHEN followers > 0 THEN followers ELSE 10000 END), 2) * (0.7 + 0.3 * coalesce(novelty, CASE WHEN followers > 200000 THEN 0.1 ELSE 0.5 END)), 6) AS score
        FROM acc LEFT JOIN nov USING (account) WHERE NOT fully_collected ORDER BY priority DESC, score DESC, account LIMIT 500""",
    "frontier_with_signal": _with(_ACC, _USES) + "SELECT count(*) AS n FROM acc WHERE NOT fully_collected AND account IN (SELECT account FROM uses)",
    "strategy_bridges": _with(*_GRAPH, _ENDS, _BRIDGES) + "SELECT account, cluster, followers FROM bridges JOIN acc USING (account) WHERE followers >= 500 ORDER BY followers DESC, account LIMIT 8",
    "boundary_tags": _with(_ACC, _USES, _BUSES, _BRANDS, _TAGS, _PAIRS, _EDGES, _ENDS, _BRIDGES) + "SELECT tag, count(*) AS cnt FROM brands WHERE account IN (SELECT account FROM bridges) GROUP BY 1 HAVING count(*) >= 2 ORDER BY cnt DESC, tag LIMIT 12",
    "axis_scores": _with(*_BR, _AXES) + "SELECT cluster, tags, round(political, 6) AS political, round(trust, 6) AS trust, round(faith, 6) AS faith, round(reach, 6) AS reach FROM axes",
    "axis_minmax": _with(*_BR, _AXES) + "SELECT cluster, " + ", ".join(f"round(CASE WHEN max({c}) OVER () = min({c}) OVER () THEN 0.5 ELSE ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) END, 6) AS {c}" for c in ("political", "trust", "faith", "reach")) + " FROM axes",
    "axis_gaps": _with(*_BR, _AXES) + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS axis, round(max({c}) - min({c}), 6) AS spread FROM axes" for c in ("political", "trust", "faith")) + ") WHERE spread < 0.5",
    "tfidf_long": _with(_USES, _BUSES, _top("buses", "b10", 10), "n AS (SELECT count(DISTINCT account) AS n FROM b10)", "f AS (SELECT tag, count(*) AS df FROM b10 GROUP BY 1 HAVING count(*) >= 3 ORDER BY df DESC, tag LIMIT 300)",
        "w AS (SELECT account AS doc, tag AS term, ln((1 + n) / CAST(1 + df AS DOUBLE)) + 1 AS w FROM b10 JOIN f USING (tag), n)") + "SELECT doc, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS value FROM w",
    "centered_features": _with(_VEC) + "SELECT vec_id, round(sum(v * v), 6) AS norm2 FROM (SELECT vec_id, value - avg(value) OVER (PARTITION BY dim) AS v FROM vec) GROUP BY 1",
    "cluster_projection": _with(_VEC) + "SELECT label, dim, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS n FROM vec GROUP BY 1, 2 HAVING count(*) >= 2",
    "eta_squared": _with(_VEC) + "SELECT dim, round(sum((gm - m) * (gm - m)) / sum((value - m) * (value - m)), 6) AS eta2 FROM (SELECT dim, value, avg(value) OVER (PARTITION BY dim) AS m, avg(value) OVER (PARTITION BY dim, label) AS gm FROM vec) GROUP BY 1",
    "pc_minmax": "WITH p AS (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS x, avg(CAST(embedding[2] AS DOUBLE)) AS y FROM embeddings GROUP BY 1) SELECT label, round((x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()), 6) AS x, round((y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()), 6) AS y FROM p",
    "spearman_axes": """WITH v AS (SELECT label, round(CAST(embedding[1] AS DOUBLE), 1) AS x, round(CAST(embedding[2] AS DOUBLE), 1) AS y FROM embeddings),
        r AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS ry FROM v)
        SELECT label, round(corr(rx, ry), 6) AS r, count(*) AS n FROM r GROUP BY 1""",
    "dial_clusters": _with(_TREE, _DIAL, _SPANS) + "SELECT dial, count(*) AS alive, count(*) FILTER (dies - born >= 0.18) AS robust FROM spans JOIN dial ON born <= dial AND (dial < dies OR dies >= 1) GROUP BY 1",
    "plateaus": _with(_TREE, _PLAT) + "SELECT CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi, round(CAST(hi - lo AS DOUBLE), 6) AS width, round(CAST(hi - lo AS DOUBLE), 6) >= 0.15 AS wide FROM plat",
    "dist_to_break": _with(_TREE, _DIAL) + "SELECT dial, round(min(abs(split_at - dial)), 6) AS dist, round(least(min(abs(split_at - dial)) / 0.16, 1.0), 6) AS stability FROM dial, tree WHERE split_at < 1 GROUP BY 1",
    "scale_trace": _with(_TREE, _SPANS, _PLAT, "chain(account, id) AS (VALUES ('x', 'root'), ('x', 'a'), ('x', 'a1'), ('x', 'a11'), ('y', 'root'), ('y', 'c'))")
        + "SELECT account, CAST(lo AS DOUBLE) AS lo, id FROM (SELECT account, lo, id, lag(id) OVER (PARTITION BY account ORDER BY lo) AS b FROM plat JOIN spans ON born <= (lo + hi) / 2 AND ((lo + hi) / 2 < dies OR dies >= 1) JOIN chain USING (id)) WHERE b IS NULL OR b <> id",
    "soft_membership_rules": _with(_ACC, _USES, _SOFT) + "SELECT state, count(*) AS accounts, round(avg(best), 6) AS best FROM (SELECT account, max(membership) AS best, CASE WHEN max(membership) < 0.3 THEN 'unknown' ELSE 'member' END AS state FROM soft GROUP BY 1) GROUP BY 1",
    "overlap_lens": _with(_ACC, _USES, _SOFT) + "SELECT x.block AS left_block, y.block AS right_block, count(*) AS shared FROM soft x JOIN soft y ON x.account = y.account AND x.block < y.block WHERE x.membership >= 0.2 AND y.membership >= 0.2 GROUP BY 1, 2",
    "coupling_weights": _with(*_BR) + "SELECT sub AS block, tag, count(*) AS weight FROM brands JOIN acc USING (account) GROUP BY 1, 2",
    "mode_detection": "SELECT conv_id, turn, CASE WHEN " + " OR ".join(f"regexp_matches(coalesce(text, ''), '(?i){p}')" for p in HYPOTHESIS_NL + HYPOTHESIS_EN) + " THEN 'hypothesis' ELSE 'match' END AS mode FROM conversations",
    "header_stats": _with(*_GRAPH, _ENDS) + "SELECT count(*) AS nodes, CAST(sum(followers) AS BIGINT) AS followers, (SELECT count(*) FROM edges) AS edges FROM acc WHERE account IN (SELECT account FROM ends)",
    "enclosing_circles": "SELECT label, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) + 26, 6) AS radius FROM (SELECT label, x, y, avg(x) OVER (PARTITION BY label) AS cx, avg(y) OVER (PARTITION BY label) AS cy FROM (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings)) GROUP BY 1",
}

_SINNER = "sin AS (SELECT x.macro, x.sub AS a, y.sub AS b, sound FROM spairs JOIN sedges USING (src, dst) JOIN acc x ON src = x.account JOIN acc y ON dst = y.account WHERE x.macro = y.macro)"
_HITS = """hits AS (SELECT signal, position, name AS username, bio AS display_name, followers FROM (SELECT DISTINCT account, tag AS signal, video AS position FROM buses) JOIN acc USING (account)),
ok AS (SELECT * FROM hits WHERE followers <= 9000 AND (followers = 0 OR followers >= 500) AND NOT contains(lower(username || ' ' || display_name), 'mach')),
fresh AS (SELECT signal, username, min(position) AS position FROM ok WHERE username NOT IN (SELECT name FROM acc WHERE fully_collected) GROUP BY 1, 2)"""
_HIT = (_ACC, _USES, _BUSES, _HITS)
_MCT = _ctags("macro")
_MFIT = _FIT.replace("sub AS cluster", "macro AS cluster").replace("acc.sub", "acc.macro")

ORACLE_SQL |= {
    "account_main_cluster": _with(_USES) + "SELECT account, p_brand AS cluster, count(*) AS cnt FROM uses JOIN part ON tag = p_partkey GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY account ORDER BY count(*) DESC, p_brand) = 1",
    "sound_cluster_sounds": _with(_ACC, _USES, _TITLED, _SEDGES, _SINNER) + "SELECT * FROM (SELECT macro AS cluster, sound, count(*) AS cnt, row_number() OVER (PARTITION BY macro ORDER BY count(*) DESC, sound) AS rank FROM sin GROUP BY 1, 2) WHERE rank <= 5",
    "sound_lift": _with(_ACC, _USES, _TITLED, _SEDGES, _SINNER,
        "own AS (SELECT * FROM (SELECT macro, a AS cluster, sound, count(*) AS cnt, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, sound) AS rank FROM sin WHERE a = b GROUP BY 1, 2, 3) WHERE rank <= 10)",
        "rest AS (SELECT cluster, o.sound, count(s.sound) AS rest FROM own o LEFT JOIN sin s ON s.macro = o.macro AND s.sound = o.sound AND s.a <> cluster AND s.b <> cluster GROUP BY 1, 2)",
        "size AS (SELECT sub AS cluster, macro, count(*) AS n, sum(count(*)) OVER (PARTITION BY macro) AS n_all FROM acc GROUP BY 1, 2)")
        + "SELECT cluster, sound, cnt, rank, round((cnt / CAST(n AS DOUBLE)) / (rest / CAST(greatest(n_all - n, 1) AS DOUBLE) + 0.01), 6) AS lift FROM own JOIN rest USING (cluster, sound) JOIN size USING (cluster)",
    "valid_hits": _with(*_HIT) + "SELECT signal, count(*) AS hits, count(DISTINCT username) AS accounts FROM ok GROUP BY 1",
    "chain_probe": _with(*_HIT, "gate AS (SELECT signal, contains(lower(username || ' ' || display_name), 'build') OR contains(lower(username || ' ' || display_name), 'furn') AS open FROM ok QUALIFY row_number() OVER (PARTITION BY signal ORDER BY position) = 1)",
        "first AS (SELECT signal, username, row_number() OVER (PARTITION BY signal ORDER BY position, username) AS rank FROM fresh)")
        + "SELECT signal, NOT any_value(open) AS abandoned, coalesce(string_agg(username, ',' ORDER BY rank) FILTER (open AND rank <= 3), '') AS accounts FROM gate LEFT JOIN first USING (signal) GROUP BY 1",
    "discovered_accounts": _with(*_HIT) + "SELECT username, signal, position FROM fresh QUALIFY row_number() OVER (PARTITION BY username ORDER BY position, signal) = 1",
    "collection_outcomes": _with(_ACC) + """SELECT CASE WHEN account % 2 = 0 AND followers BETWEEN 1 AND 999 THEN 'skipped' WHEN account NOT IN (SELECT o_custkey FROM orders) THEN 'unavailable' WHEN followers < 1000 THEN 'too small'
        WHEN in_scope IS DISTINCT FROM true THEN 'out of scope' ELSE 'collected' END AS outcome, count(*) AS accounts FROM acc GROUP BY 1""",
    "session_credits": _with(_ACC, "c AS (SELECT sub, 2 + account % 5 AS credits, sum(2 + account % 5) OVER (PARTITION BY sub ORDER BY account) AS run FROM acc)") + "SELECT sub, count(*) AS accounts, CAST(sum(credits) AS BIGINT) AS credits FROM c WHERE run - credits < 100 GROUP BY 1",
    "node_export": _with(*_GRAPH, _ENDS, _BUSES, _BRANDS, _density("macro"), _MCT, _MFIT, _BRIDGES.replace(".sub", ".macro"), "idx AS (SELECT cluster, row_number() OVER (ORDER BY size DESC, cluster) AS cluster_index FROM dens WHERE size >= 8 AND density >= 0.03)")
        + "SELECT account, followers, cluster_index, CAST(sub AS VARCHAR) AS sub_label, round(fit, 3) AS fit_score, fit < 0.15 AND cluster_index IS NOT NULL AS is_outlier, account IN (SELECT account FROM bridges) AS is_bridge FROM acc JOIN fit USING (account) LEFT JOIN idx ON idx.cluster = macro",
    "cluster_tree_json": _with(_ACC, """leaf AS (SELECT macro, sub, bio, count(*) AS n, CAST(sum(followers) AS BIGINT) AS f, macro || '·' || sub || '·' || bio AS id FROM acc GROUP BY 1, 2, 3)""",
        """mid AS (SELECT macro, macro || '·' || sub AS id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(f) AS BIGINT) AS f, string_agg('{"id":"' || id || '","size":' || n || ',"reach":' || f || ',"subclusters":[]}', ',' ORDER BY n DESC, id) AS kids FROM leaf GROUP BY macro, sub)""")
        + """SELECT CAST(macro AS VARCHAR) AS id, '{"id":"' || macro || '","size":' || CAST(sum(n) AS BIGINT) || ',"reach":' || CAST(sum(f) AS BIGINT) || ',"subclusters":[' || string_agg('{"id":"' || id || '","size":' || n || ',"reach":' || f || ',"subclusters":[' || kids || ']}', ',' ORDER BY n DESC, id) || ']}' AS json FROM mid GROUP BY macro""",
    "naming_requests": _with(*_GRAPH, _BUSES, _BRANDS, _density("sub"), _ctags("sub", 8),
        "tops AS (SELECT sub AS cluster, account, row_number() OVER (PARTITION BY sub ORDER BY followers DESC, account) AS rank FROM acc)",
        "t AS (SELECT cluster, string_agg('#' || tag, ', ' ORDER BY rank) AS tags, string_agg(tag, ',' ORDER BY tag) FILTER (rank <= 5) AS key FROM ctags GROUP BY 1)")
        + """SELECT cluster, key, 'Name this group.' || chr(10) || 'accounts: ' || size || chr(10) || 'density: ' || CAST(round(100 * density, 0) AS BIGINT) || ' %' || chr(10) || 'tags: ' || tags || chr(10) || 'most followed: '
        || (SELECT string_agg('@' || account, ', ' ORDER BY rank) FROM tops WHERE tops.cluster = t.cluster AND rank <= 6) || chr(10) || 'Reply with JSON: {"name": three to six words without tags, "description": one sentence}' AS prompt
        FROM t JOIN dens USING (cluster) WHERE key NOT IN (SELECT key FROM t WHERE cluster % 4 = 0)""",
    "rebuild_profiles": _with(_ACC, _USES, _BUSES, _BRANDS, "many AS (SELECT account FROM buses GROUP BY 1 HAVING count(DISTINCT video) >= 5)", "lists AS (SELECT account, string_agg(tag, ',' ORDER BY rank) AS l FROM brands JOIN many USING (account) GROUP BY 1)")
        + "SELECT account, r AS rebuilt, CASE WHEN r THEN l ELSE bio END AS tags FROM (SELECT account, bio, l, coalesce(fully_collected AND in_scope, false) AND l IS NOT NULL AS r FROM acc LEFT JOIN lists USING (account))",
    "publish_new_parts": _with(_ACC, "p AS (SELECT macro AS cluster, sub || '-' || strftime(o_orderdate, '%m') AS part, o_orderdate AS ts FROM orders JOIN acc ON o_custkey = account)",
        f"o AS (SELECT DISTINCT cluster, part FROM p WHERE ts < TIMESTAMP '{SPLIT}' AND cluster <> 2 AND part NOT LIKE '%07')", f"n AS (SELECT DISTINCT cluster, part FROM p WHERE ts >= TIMESTAMP '{SPLIT}')")
        + "SELECT * FROM (FROM n EXCEPT FROM o) WHERE cluster IN (SELECT cluster FROM o)",
    "contract_rules": """SELECT 'recommended level' AS rule, '4' AS id UNION ALL SELECT 'parent exists', 'n' || n_nationkey FROM nation WHERE n_nationkey = 7
        UNION ALL SELECT 'parent of same kind', 'n' || n_nationkey FROM nation WHERE n_nationkey = 5 UNION ALL SELECT 'parent one level above', 'n' || n_nationkey FROM nation WHERE n_nationkey = 3
        UNION ALL SELECT 'overlap of two blocks', 'o' || n_nationkey FROM nation WHERE n_nationkey + 1 NOT IN (SELECT n_nationkey FROM nation)""",
}
