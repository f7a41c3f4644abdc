"""The exact dedup writes no table of its own and gives its result in few partitions, as each file starts processes from an executor."""

import os

from shoal.llm.exact import exact_duplicates


def test_no_files_and_few_partitions(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7 if i % 2 else 0}") for i in range(400)], "doc_id long, text string")
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(folder))
    out = exact_duplicates(docs, 40)
    rows = out.collect()
    assert set(os.listdir(folder)) == before
    assert out.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    groups = {}
    for i in range(400):
        groups.setdefault(i % 7 if i % 2 else 0, []).append(i)
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in rows) == sorted((i, g[0], len(g), i == g[0]) for g in groups.values() for i in g)
