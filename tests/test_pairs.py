"""Pairs of a least shared weight against all pairs, written out."""

import random

import pytest
from pyspark.sql import functions as F

from shoal.operators import graph, pairs


@pytest.mark.parametrize("chunk,far", [(pairs.CHUNK, 0), (7, 0), (50, 2**40)])
@pytest.mark.parametrize("least", [1, 4, 7])
def test_same_as_all_pairs(spark, monkeypatch, chunk, far, least):
    rng = random.Random(least)
    monkeypatch.setattr(pairs, "CHUNK", chunk)
    a = [(rng.randrange(60) * (1 + far) - 20, rng.randrange(80)) for _ in range(500)] + [(1, None), (None, 3)]
    b = [(x * (1 + far) - 20, f"s{rng.randrange(9)}") for x in range(50) for _ in range(2)]
    c = [(x * (1 + far) - 20, f"t{x % 4}") for x in range(60)]
    a, b, c = spark.createDataFrame(a + a[:9], "account long, tag long"), spark.createDataFrame(b, "account long, tag string"), spark.createDataFrame(c, "account long, tag string")
    want = graph.combine(graph.cooccurrence(a, 3), graph.cooccurrence(b, 1), graph.cooccurrence(c, 2)).where(F.col("weight") >= least)
    got = pairs.shared([(a, 3, None), (b, 1, 2), (c, 2, 1)], least)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_token_of_all_accounts_that_is_too_weak_by_itself(spark):
    """Written out it would be 800 million pairs."""
    every = spark.range(40_000).select(F.col("id").alias("account"), F.lit("all").alias("tag"))
    few = spark.createDataFrame([(5, 1), (39_999, 1), (6, 2), (8, 2)], "account long, tag long")
    assert sorted(map(tuple, pairs.shared([(few, 3, 1), (every, 2, 1)], 4).collect())) == [(5, 39_999, 5), (6, 8, 5)]
    assert pairs.shared([(few.limit(0), 3, 1), (every, 2, 1)], 4).count() == 0


@pytest.mark.parametrize("weak,strong", [(2, 6), (4, 4), (6, 2)])
def test_prune_by_weight_and_sparse_ends(spark, weak, strong):
    e = [(a, b, w) for w, (a, b) in enumerate((a, b) for a in range(4) for b in range(a + 1, 4))] + [(0, 1, 9), (2, 3, 3)]
    got = graph.adaptive_prune(spark.createDataFrame(e, "src long, dst long, weight long"), spark.createDataFrame([(0,), (1,), (2,), (1,)], "account long"), weak, strong)
    assert sorted(map(tuple, got.collect())) == sorted(x for x in e if x[2] >= (weak if max(x[:2]) < 3 else strong))
    if weak < strong:  # edges of the upper weight take no part in the join
        assert "weight#" in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "Union" in plan and "LeftOuter" not in plan


def test_connected_reads_the_edges_once(spark):
    nodes, edges = spark.range(9).select(F.col("id").alias("account")), spark.range(3).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(5).alias("weight"))
    got = graph.connected(nodes, edges)
    assert sorted(r.account for r in got.collect()) == [0, 1, 2, 3]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Range (0, 3") == 1
