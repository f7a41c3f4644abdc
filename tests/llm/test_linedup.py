"""Line dedup against brute force over all earlier documents."""

from __future__ import annotations

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

import corpus_pipeline
from shoal.llm import linedup


def brute(rows, least):
    """Lines of each document that lie in a run of that many words which stands in one earlier document."""
    out = {}
    for at, (doc_id, text) in enumerate(rows):
        mine, gone = text.split("\n"), set()
        for _, other in rows[:at]:
            theirs = other.split("\n")
            for i in range(len(mine)):
                for j in range(len(theirs)):
                    n = 0
                    while i + n < len(mine) and j + n < len(theirs) and mine[i + n] == theirs[j + n]:
                        n += 1
                    if sum(len(x.split()) for x in mine[i : i + n]) >= least:
                        gone |= set(range(i, i + n))
        out[doc_id] = "\n".join(x for i, x in enumerate(mine) if i not in gone)
    return out


def test_lines_that_a_third_document_holds_in_another_order(spark):
    line = lambda k: f"{k} a b c d e f g h i"
    text = lambda *ks: "\n".join(map(line, ks))
    passage = ("r1", "c1", "r2", "c2", "r3", "c3")
    rows = [(1, text("x", "c3", "y", "c2", "z", "c1")), (2, text("p", *passage)), (3, text("c2", "q", *passage, "t"))]
    got = {r.doc_id: (r.text, r.removed_lines, r.partners) for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (rows[0][1], 0, []), 2: (rows[1][1], 0, []), 3: (text("c2", "q", "t"), 6, [2])}


def test_every_run_of_an_earlier_document_goes(spark):
    rng = random.Random(3)
    lines = [" ".join(f"l{k}w{i}" for i in range(rng.randrange(1, 16))) for k in range(8)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 14)))) for i in range(60)]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, linedup.MIN_WORDS) and got != dict(rows)


@given(st.lists(st.integers(1, 40), max_size=12))
def test_windows_cover_every_run(words):
    found = linedup.windows(words, 30)
    for i in range(len(words)):
        for j in range(i, len(words)):
            inside = {k for a, b in found if i <= a and b <= j for k in range(a, b + 1)}
            assert inside == (set(range(i, j + 1)) if sum(words[i : j + 1]) >= 30 else set())


def test_extra_columns_that_clash(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, 5, 6, "a", [1]), (2, text, 7, 8, "b", None), (None, text, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shoal_id int, shoal_th int, shoal_blocks string, shoal_partners array<int>")
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, "")
    assert out.columns == docs.columns and sorted(map(tuple, out.collect()), key=repr) == sorted([rows[0], (2, "", *rows[1][2:]), rows[2]], key=repr)
    with pytest.raises(ValueError):
        linedup.edit_lines(docs)


def test_one_page_on_which_all_depend(spark):
    """A passage on every page is taken from all but the first, pages of many partners included."""
    passage = "\n".join(f"terms {i} " + "and conditions apply to every use " * 2 for i in range(5))
    own = lambda k: "\n".join(f"page {k} line {i} " + "of text that is its own " * 4 for i in range(3))
    rows = [(k, f"{own(k)}\n{passage}\n{own(k + 1000)}") for k in range(200)] + [(500, "\n".join(own(k) for k in range(40)))]
    got = {r.doc_id: (r.text, r.partners) for r in linedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0] == (rows[0][1], []) and got[500] == ("", list(range(40)))
    assert all(got[k] == (f"{own(k)}\n{own(k + 1000)}", [0]) for k in range(1, 200))


@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_is_of_equal_lines_in_order(left, right):
    out = linedup.patience_diff(left, right)
    assert all(left[i] == right[j] for i, j in out) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(out, out[1:]))
    if left == right:
        assert out == [(i, i) for i in range(len(left))]


@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 5), max_size=14))
def test_blocks_equal_all_common_runs(left, right):
    words = lambda x: [3 * k + 1 for k in x]
    gone = {i for first, last in linedup.common_blocks(left, words(left), right, words(right), 30) for i in range(first, last + 1)}
    want = set()
    for i in range(len(left)):
        for j in range(len(right)):
            n = 0
            while i + n < len(left) and j + n < len(right) and left[i + n] == right[j + n]:
                n += 1
            if sum(words(left[i : i + n])) >= 30:
                want |= set(range(i, i + n))
    assert gone == want
