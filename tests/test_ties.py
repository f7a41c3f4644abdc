"""Communities over packed ties against those over written ones."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoal.operators import community, graph, ties
from shoal.plans import bindings as b
from shoal.plans import queries

SF = "/root/testdata/sf0.001"


def test_packed_integers():
    for x in ([], [0], [5, -3, 2**62, -(2**63)], list(range(1000))):
        assert [a.tolist() for a in ties._unpack(ties._pack(np.array(x, dtype=np.int64), np.array([7])))] == [x, [7]]


def by_rows(s, d):
    """tag_communities with its ties written as rows."""
    u, band = b.uses(s, d), queries.df_band_filter(s, d).select("tag")
    rows = graph.cooccurrence(u.join(band, "tag", "left_semi").select("video", "tag"), 1, owner="tag", token="video")
    return graph.main_cluster(u, community.partition(rows).withColumnRenamed("account", "tag"))


@pytest.mark.parametrize("most", [community.MAX_EDGES, 5])
@pytest.mark.parametrize("chunk,ends,far", [(ties.CHUNK, ties.ENDS, 1), (7, 50, -(2**40))])
def test_same_as_written_ties(spark, monkeypatch, most, chunk, ends, far):
    rng = random.Random(3)
    monkeypatch.setattr(community, "MAX_EDGES", most)
    monkeypatch.setattr(ties, "CHUNK", chunk)
    monkeypatch.setattr(ties, "ENDS", ends)
    rows = [(t, (rng.randrange(20) + 20 * (t % 3 if rng.random() < 0.9 else 1)) * far) for t in range(120) for _ in range(rng.randrange(7))] + [(500, x * far) for x in range(60)] + [(501, 999), (502, None)]
    tokens = spark.createDataFrame(rows, "token long, member long")
    nodes = spark.createDataFrame([(x * far,) for x in range(60) if x % 11] + [(123456,), (None,)], "member long")
    want = community.partition(graph.cooccurrence(tokens.join(nodes, "member", "left_semi"), owner="member", token="token"))
    got = ties.communities(tokens.groupBy("token").agg(F.collect_set("member").alias("m")).select("m"), nodes)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert ties.communities(tokens.limit(0).groupBy("token").agg(F.collect_set("member").alias("m")).select("m"), nodes).count() == 0
    assert ties.communities(tokens.groupBy("token").agg(F.collect_set("member").alias("m")).select("m"), nodes.limit(0)).count() == 0


def written(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def test_tag_communities_leave_the_ties_unwritten(spark, monkeypatch):
    """Propagated over more ties than one task takes, with less in the shared folder than the ties' rows and labels would be."""
    monkeypatch.setattr(community, "MAX_EDGES", 5)
    folder, size = spark.conf.get("spark.checkpoint.dir"), []
    for query in (by_rows, queries.tag_communities):
        before = written(folder)
        size.append((sorted(map(tuple, query(spark, SF).collect())), written(folder) - before))
    assert size[0][0] == size[1][0] != []
    assert size[1][1] < size[0][1] / 3
