"""Quality learns from every labelled text."""

from __future__ import annotations

import numpy as np

from shoal.llm import quality


def test_texts_that_a_sample_would_leave_out_count(spark):
    """Of 8800 labelled texts all enter the means and the threshold's share of bad ones."""
    docs = spark.range(11_000).selectExpr("id AS doc_id", "concat(repeat(concat('word', id, ' '), 1 + cast(id % 7 as int)), IF(id % 4 = 0, ' ### $$$ !!!', ' plain.')) AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 != 0 as int) AS quality")
    model = quality.train_quality(docs, labels)
    rows = [r for r in docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 != 0").collect()]
    x = quality.feature_matrix(quality.pa.array([r.text for r in rows]), quality.WordTable(quality._shape, 10))
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0) + 1e-6)
    bad = np.array([r.doc_id % 4 == 0 for r in rows])
    assert ((model.score(x) < quality.CUT) == bad).mean() > 0.99


def test_ranks_are_those_of_all_scores():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(3001, 4)), rng.integers(0, 2, 3001)
    x[:, 0] += 2 * y
    model = quality.fit_pairs(x, y)
    raw, level = (x - model.mean) / model.scale @ model.weights, (y == 0).mean()
    want = [np.sort(raw)[int(q * (len(raw) - 1))] for q in (level - 0.005, level + 0.005)]
    assert abs(model.threshold - sum(want) / 2) < 1e-4
