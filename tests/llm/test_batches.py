"""Batches of the pipeline's stages are a few million bytes, however long the texts are; a size that the session names holds."""

import pyarrow as pa
import pytest

import corpus_pipeline

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


@corpus_pipeline.few_files
def stage(spark, docs, sf_dir):
    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    return docs.mapInArrow(sizes, "n long, size long")


@pytest.mark.parametrize("own", [None, "16m"])
def test_batches_are_bounded(spark, own):
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('abcdefgh ', 11000) AS text")
    spark.conf.unset(KEY)
    if own:
        spark.conf.set(KEY, own)
    try:
        rows = stage(spark, docs, "").collect()
    finally:
        spark.conf.unset(KEY)
    assert sum(r.n for r in rows) == 300
    most = max(r.size for r in rows)
    assert most <= 4_500_000 if own is None else 12_000_000 < most < 18_000_000
