"""Near duplicates through wide fingerprints, against brute force over all pairs of shingle sets."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from shoal.llm import simhash, simhash_wide


def shingles(text, width=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute(rows, similarity=0.8):
    """Least doc_id reachable over pairs of that similarity, by row."""
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    near = [[j for j, y in enumerate(sets) if x == y or len(x & y) >= similarity * len(x | y)] for x in sets]
    while (new := [min(comp[j] for j in near[i]) for i in range(len(rows))]) != comp:
        comp = new
    least = {}
    for (doc_id, _), c in zip(rows, comp):
        if doc_id is not None:
            least[c] = min(doc_id, least.get(c, doc_id))
    return sorted(((i, least.get(c)) for (i, _), c in zip(rows, comp)), key=repr)


def edited(rng, words, n):
    words = words[:]
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    """Copies edited more and more, chains of edits, common passages, short, empty and null texts."""
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    common, texts = prose(60), []
    for _ in range(12):
        base = prose(rng.randrange(60, 300))
        texts += [base, *(edited(rng, base, rng.randrange(1, 1 + len(base) // 30)) for _ in range(6)), edited(rng, base, len(base) // 8)]
    chain = prose(120)
    for _ in range(20):
        texts.append(chain := edited(rng, chain, 2))
    texts += [prose(rng.randrange(1, 60)) + common for _ in range(60)] + [prose(k) for k in range(9)] + [["one"], ["one"], ["two", "words"], ["TWO", "words"]]
    out = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return [(7, "another text"), (500, None), (501, ""), (502, " \t "), (None, "one"), (None, None), (None, "only without id"), *out]


def found(spark, rows, **how):
    got = simhash_wide.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **how)
    return sorted(((r.doc_id, r.component_id) for r in got.collect()), key=repr)


@pytest.mark.parametrize("block", [simhash_wide.BLOCK, 5])
def test_links_are_true_and_few_are_missed(spark, rows, block):
    """Nothing that isn't alike is joined; of the rows that go by brute force 97 of 100 go at least."""
    got, want = found(spark, rows, block=block), brute(rows)
    assert [i for i, _ in got] == [i for i, _ in want]
    lead = {i: c for i, c in want if i is not None}
    assert all(lead[c] == lead[i] for i, c in got if i is not None)
    gone = lambda out: sum(i is not None and i != c for i, c in out)
    assert gone(got) >= 0.97 * gone(want) > 50


@pytest.mark.parametrize("block", [simhash_wide.BLOCK, 40])
def test_copies_of_one_text_that_are_less_like_each_other(spark, block):
    """Two of them share about 0.7: only the text they were copied from ties them."""
    rng = random.Random(6)
    base = [f"u{rng.randrange(9000)}" for _ in range(150)]
    rows = [(k, " ".join(edited(rng, base, 3) if k else base)) for k in range(300)]
    assert brute(rows) == [(k, 0) for k in sorted(range(300), key=lambda k: repr((k, 0)))]
    assert sum(c == 0 for _, c in found(spark, rows, block=block)) >= 0.98 * 300


def test_awkward_rows(spark):
    rows = [(7, None), (8, ""), (None, " \t"), (3, "one"), (3, "one"), (4, "ONE"), (None, "only without id"), (5, "a b c d e f " * 20000), (6, "a b c d e f " * 20001)]
    assert found(spark, rows) == brute(rows)
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, sig string, id int, component_id int")
    out = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, len(r.text or "")) for r in out.collect()), key=repr) == sorted([(7, 0), (3, 3), (3, 3), (None, 15), (5, 240000)], key=repr)
    assert simhash_wide.near_components(docs.limit(0)).count() == 0


def test_fingerprint_bits():
    """Bit by bit as defined, for more shingles than one count holds."""
    (s,) = simhash_wide.shingle_sets(pa.array([" ".join(map(str, range(9000)))]))
    step = [(k * 0x9E3779B97F4A7C15) % 2**64 for k in range(1, simhash_wide.WORDS + 1)]
    for k, word in enumerate(simhash_wide.wide_fingerprint(s).tolist()):
        h = simhash_wide._mix(s + np.uint64(step[k]))
        assert word == sum(1 << b for b in range(64) if 2 * int(((h >> np.uint64(b)) & np.uint64(1)).sum()) > len(s))


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_runs_come_whole_or_in_blocks(block):
    rng = np.random.default_rng(block)
    key = np.sort(np.concatenate([rng.integers(0, 40, 60), np.full(50, 17)]))
    table, got, cuts = np.stack([key, np.arange(len(key))]), [], sorted(rng.integers(0, len(key), 6).tolist())
    batches = [pa.record_batch([pa.array(table[0, a:b]), pa.array(table[1, a:b])], names=["k", "v"]) for a, b in zip([0, *cuts], [*cuts, len(key)])]
    numbers = {}
    for part, number in simhash.key_runs(iter(batches), block):
        got.append(part)
        size = np.unique(part[0], return_counts=True)
        assert all(n <= block for n in size[1].tolist())
        if number is None:
            assert all(n == (key == k).sum() for k, n in zip(*(x.tolist() for x in size)))
        else:
            assert len(size[0]) == 1 and numbers.setdefault(int(part[0, 0]), []) == list(range(number))
            numbers[int(part[0, 0])].append(number)
    rows = np.concatenate(got, axis=1)
    assert sorted(rows[1].tolist()) == list(range(len(key)))


def test_stage_drops_lightly_edited_copies(spark):
    rng = random.Random(5)
    rows = []
    for k in range(20):
        base = [f"v{rng.randrange(5000)}" for _ in range(200)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(edited(rng, base, 4)))]
    out = dict(corpus_pipeline.STAGES)["simhash near-dedup"](spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in out.collect()} == {i for i, c in brute(rows) if i == c} == set(range(0, 40, 2))


def test_candidates_of_one_large_group_are_few(spark, monkeypatch):
    """Each copy is a candidate some ten times, not under each of its 306 keys."""
    rng, made, keep = random.Random(6), [], simhash_wide.materialise
    base = [f"u{rng.randrange(9000)}" for _ in range(150)]
    rows = [(k, " ".join(edited(rng, base, 1 + k % 3) if k else base)) for k in range(300)]

    def counted(df, narrow=False):
        out = keep(df, narrow)
        if out.columns == ["a", "b", "key", "number", "block"]:
            made.append(out.where("a IS NOT NULL").count())
        return out

    monkeypatch.setattr(simhash_wide, "materialise", counted)
    assert sum(c == 0 for _, c in found(spark, rows)) >= 0.98 * 300
    assert sum(made) < 25_000, made
