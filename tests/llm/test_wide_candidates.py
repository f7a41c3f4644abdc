"""Later rounds of near-dedup take sets of which a key has left out a near pair, not all that a key has once brought together."""

import random

import numpy as np

from shoal.llm import simhash_wide as w


def test_pairs_of_open_ends():
    near = (np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4]))
    assert w._some_left(5, near, (np.array([1, 0, 3]), np.array([0, 2, 4]))).tolist() == [True, True, False]  # of 1 and 2 the pair with each other is left out
    assert w._some_left(5, near, (np.array([0, 2, 0, 4, 1]), np.array([1, 0, 2, 3, 2]))).tolist() == [False] * 5  # given twice counts once


def test_settled_pairs_are_no_candidates(spark, monkeypatch):
    """Pairs that met by chance, all of them compared, don't come again; copies of one text do."""
    rng, made, keep = random.Random(3), [], w._variants
    prose = lambda n: [f"t{rng.randrange(9000)}" for _ in range(n)]
    base = prose(150)
    copies = [base[:] for _ in range(61)]
    for k, at in ((k, at) for k in range(1, 61) for at in rng.sample(range(150), 2)):
        copies[k][at] = f"new{k}"
    rows = [(k, " ".join(t)) for k, t in enumerate(copies + [prose(9) for _ in range(3000)])]

    def counted(one, *kept, **how):
        if len(kept) > 3:
            made.append(one.count())
        return keep(one, *kept, **how)

    monkeypatch.setattr(w, "_variants", counted)
    out = w.near_components(spark.createDataFrame(rows, "doc_id long, text string"), most=26).collect()
    comp = {r.doc_id: r.component_id for r in out}
    assert sum(comp[k] == 0 for k in range(61)) >= 60 and all(comp[k] == k for k in range(61, len(rows)))
    assert made and all(61 <= n < 300 for n in made), made
