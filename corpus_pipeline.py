"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept,
and is written and read again before the next. All but the last give the columns
that ``docs`` has.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm._base import fresh, gathered, materialise
from shoal.llm.decontam import drop_leaks
from shoal.llm.linedup import edit_lines
from shoal.llm.packing import pack_documents
from shoal.llm.registry import tokenizer_path
from shoal.llm.simhash_wide import near_components
from shoal.llm.toxicity import drop_toxic, train_toxicity


#: Bytes of a batch that goes to a Python worker, as much as the stages take in one go; Spark's 64 MB are held several times by executor and worker.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on the session's batches have BATCH bytes or a row, unless it names a size of its own (read when a plan runs, so it stays set)."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def few_files(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with its result in some two partitions a core, whoever writes it, and with small batches."""

    @wraps(stage)
    def gathered_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return gathered(stage(spark, docs, sf_dir))

    return gathered_stage


@few_files
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs, train_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


@few_files
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that repeat an earlier document go from the text; every document stays.

    Where a text changes and there is a column n_chars, it follows.
    """
    removed, partners = fresh(docs, "shoal_removed", "shoal_partners")
    out = edit_lines(docs, removed=removed, partners=partners)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@few_files
def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays.

    Near duplicates share 0.8 or more of their 5-word shingles (Jaccard), verified on
    whole texts that wide fingerprints bring together. A row without doc_id goes if
    its group has an id; rows of a group without any stay, as do repeated rows of the
    document that stays.
    """
    row, th = fresh(docs, "shoal_id", "shoal_th")
    near = near_components(docs).where("component_id IS NOT NULL AND (doc_id IS NULL OR doc_id != component_id)")
    none = F.lit(-(2**63))
    gone = near.select(F.coalesce("doc_id", none).alias(row), F.col("th").alias(th)).distinct()
    on = (F.coalesce(docs["doc_id"].cast("long"), none) == gone[row]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == gone[th])
    return docs.join(gone, on, "left_anti")


@few_files
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item go, with or without doc_id; other rows of the same doc_id stay."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@few_files
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("simhash near-dedup", simhash), ("benchmark decontamination", decontamination), ("best-fit packing", packing)]

#: Learnt scores, alignment, fingerprints, search and packing aren't expressible in SQL; tests/llm checks each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
