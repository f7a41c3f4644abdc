"""The decontamination stage judges each row by its own text."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_rows_without_or_with_repeated_doc_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = spark.createDataFrame([(None, f"before {item} after"), (None, "clean"), (1, item), (1, "clean too"), (2, None)], "doc_id long, text string")
    out = dict(corpus_pipeline.STAGES)["benchmark decontamination"](spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(None, "clean"), (1, "clean too"), (2, None)], key=repr)
