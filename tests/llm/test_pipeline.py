"""The pipeline's stages on planted documents, and awkward ones."""

from __future__ import annotations

import random

import pytest

import corpus_pipeline
from test_operators import brute_leaks

SF = "/root/testdata/sf0.01"
STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark):
    """Documents of sf0.01 and planted cases from id 100,000 on."""
    rng = random.Random(9)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    passage = "\n".join(prose(rng, 14) for _ in range(5))
    long = prose(rng, 400)
    near = long.upper() + " again"  # a copy but for case and one shingle
    texts = {
        "clean": [prose(rng, 120) + "\n" + prose(rng, 60) for _ in range(20)],
        "copies": [long, long, near],
        "passage": [f"{prose(rng, 60)}\n{passage}\n{prose(rng, 40)}" for _ in range(3)],
        "leak": [f"{prose(rng, 300)} {item} {prose(rng, 50)}"],
        "toxic": [" ".join(w if i % 12 else rng.choice(["idiot", "moron", "scum", "worthless", "stupid", "trash"]) for i, w in enumerate(prose(rng, 120).split()))],
    }
    base = spark.read.parquet(f"{SF}/documents.parquet")
    ids, rows = {}, []
    for kind, ts in texts.items():
        ids[kind] = list(range(100_000 + len(rows), 100_000 + len(rows) + len(ts)))
        rows += [(100_000 + len(rows) + k, t, "en", "src0", len(t)) for k, t in enumerate(ts)]
    rows += [(200_000, None, None, None, None), (200_001, "", None, None, 0), (200_001, "", None, None, 0), (None, "a b c", None, None, None)]
    return base.unionByName(spark.createDataFrame(rows, base.schema)).cache(), ids, passage


def ids_of(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def leads(rows, similarity=0.8):
    """The least doc_id of each group of texts whose sets of 5-word shingles have that similarity, over all pairs that share a shingle."""
    first, holders, up = {}, {}, {}
    for r in rows:
        words = (r.text or "").lower().split()
        s = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()
        if r.doc_id is not None:
            first[s] = min(r.doc_id, first.get(s, r.doc_id))

    def find(s):
        while up.get(s, s) != s:
            s = up[s]
        return s

    for s in first:
        for other in {o for g in s for o in holders.get(g, ())}:
            if len(s & other) >= similarity * len(s | other):
                a, b = sorted((find(s), find(other)), key=first.get)
                up[b] = a
        for g in s:
            holders.setdefault(g, []).append(s)
    return {i for s, i in first.items() if find(s) == s}


def test_toxicity_stage(spark, planted):
    docs, ids, _ = planted
    out = STAGES["toxicity"](spark, docs, SF)
    assert out.columns == docs.columns
    left = ids_of(out)
    assert not left & set(ids["toxic"]) and set(ids["clean"] + ids["copies"] + ids["leak"]) | {200_000, 200_001, None} <= left


def test_line_stage(spark, planted):
    docs, ids, passage = planted
    out = STAGES["line dedup"](spark, docs, SF)
    assert out.columns == docs.columns and out.count() == docs.count()
    got = {r.doc_id: r for r in out.collect()}
    was = {r.doc_id: r.text for r in docs.collect()}
    assert [passage in got[i].text for i in ids["passage"]] == [True, False, False]
    assert all(got[i].text == was[i] for i in ids["clean"]) and got[200_000].text is None
    changed = [i for i in got if got[i].text != was[i]]
    assert all(got[i].n_chars == len(got[i].text) for i in changed)


def test_simhash_stage(spark, planted):
    docs, ids, _ = planted
    out = STAGES["simhash near-dedup"](spark, docs, SF)
    left = ids_of(out)
    assert out.columns == docs.columns and left & set(ids["copies"]) == {ids["copies"][0]}
    assert set(ids["clean"]) <= left and None in left
    stays = leads(docs.collect())
    # Whatever brute force keeps stays; of what it drops 3 of 100 may.
    assert stays <= left and len(left - stays - {None}) <= 0.03 * (docs.count() - len(stays))


def test_decontamination_stage(spark, planted):
    docs, ids, _ = planted
    out = STAGES["benchmark decontamination"](spark, docs, SF)
    left = ids_of(out)
    want = {i for i, _ in brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])}
    assert out.columns == docs.columns and left == ids_of(docs) - want and set(ids["leak"]) <= want and not want & set(ids["clean"])


def test_packing_stage_and_run(spark, planted):
    docs, _, _ = planted
    out = STAGES["best-fit packing"](spark, docs, SF)
    assert ids_of(out) == ids_of(docs)
    ran = corpus_pipeline.run(spark, SF)
    assert 0 < ran.count() and ids_of(ran) < ids_of(docs)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5


def test_empty_documents(spark, planted):
    docs = planted[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_extra_columns_pass_through(spark, planted):
    docs = planted[0].limit(30).selectExpr("*", "1 as score", "'x' as partners", "2 as removed_lines", "3L as component_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.where("score <> 1 or partners <> 'x' or removed_lines <> 2 or component_id <> 3").count() == 0, name


def test_results_come_in_few_partitions(spark):
    """Each file that is written starts processes from the executor that writes it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300).repartition(60)
    most = 2 * spark.sparkContext.defaultParallelism
    for name in ("toxicity", "line dedup", "benchmark decontamination"):
        out = STAGES[name](spark, docs, SF)
        assert out.rdd.getNumPartitions() <= most, name
