"""Exact duplicates by content sort, with DataFrame operations only.

Sampled splitters cut the order (first bytes, digest, id) into ranges; each range
is sorted externally, which places equal texts next to each other, and each row is
compared in full with its neighbour. A group that runs over several ranges is put
together from the edge rows of the ranges, two a range at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoal.llm._base import gathered, partitions

#: Characters of the text that lead the sort order, and sampled rows for each range.
LEAD, SAMPLES_PER_RANGE = 64, 40


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _range_of(key: Column, splitters: Column, n: int) -> Column:
    """Binary search of ``key`` among ``n`` sorted splitters: how many are not above it."""
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(splitters, at + step - 1) <= key), at + step).otherwise(at),
    )


def exact_duplicates(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Groups of equal texts: doc_id, keep_id, group_size, kept, text_sha256; a row per row.

    Null text counts as empty. A row without doc_id counts in its group but is
    never the one that stays, unless the whole group is without ids (keep_id is
    then null and kept false). Rows repeating a doc_id are members of their own;
    each that bears the smallest id has kept = true. An empty table gives an empty
    result, and other columns are ignored.
    """
    spark = docs.sparkSession
    ranges = ranges or partitions(spark)
    rows = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    key = F.struct(F.substring("norm", 1, LEAD).alias("lead"), F.col("sha").alias("sha"), F.coalesce("doc_id", F.lit(-(2**63))).cast("long").alias("id"))

    total = docs.count()
    share = min(1.0, SAMPLES_PER_RANGE * ranges / max(total, 1))
    # The sample orders the work and drops no row; it holds about SAMPLES_PER_RANGE keys a range.
    keys = [r.k for r in docs.sample(False, share, 11).select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256)).select(key.alias("k")).collect()]
    keys.sort(key=lambda k: (k.lead.encode(), k.sha, k.id))
    cuts = [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []
    cuts = [c for i, c in enumerate(cuts) if i == 0 or c != cuts[i - 1]]
    if cuts:
        splitters = F.array(*(F.struct(F.lit(c.lead).alias("lead"), F.lit(c.sha).alias("sha"), F.lit(c.id).cast("long").alias("id")) for c in cuts))
        rows = rows.withColumn("range", _range_of(key, splitters, len(cuts)))
    else:
        rows = rows.withColumn("range", F.lit(0))

    sort = Window.partitionBy("range").orderBy(F.substring("norm", 1, LEAD), "sha", "norm", "doc_id")
    placed = (
        rows.repartitionById(len(cuts) + 1, F.col("range"))
        .withColumn("starts", F.when(F.lag("norm").over(sort) == F.col("norm"), 0).otherwise(1))
        .withColumn("last", F.lead("sha").over(sort).isNull())
        .withColumn("run", F.sum("starts").over(sort.rowsBetween(Window.unboundedPreceding, 0)))
        .drop("norm", "starts")
    )
    runs = Window.partitionBy("range", "run")
    # Read twice, not written: both readers share the shuffle and sort what it holds again, which costs less than
    # a table does. Each file of one starts processes from an executor.
    in_range = (
        placed.withColumn("keep", F.min("doc_id").over(runs))
        .withColumn("size", F.count(F.lit(1)).over(runs))
        .withColumn("edge", (F.col("run") == 1) | F.max("last").over(runs))
        .select("doc_id", "range", "sha", "keep", "size", "edge")
    )
    # At most two groups of each range touch its edges: as many rows as there are ranges.
    joined = (
        in_range.where("edge").groupBy("sha", "range").agg(F.min("keep").alias("keep"), F.max("size").alias("size"))
        .groupBy("sha").agg(F.min("keep").alias("all_keep"), F.sum("size").alias("all_size"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n")
    )
    keep = F.coalesce("all_keep", "keep")
    return gathered(
        in_range.join(F.broadcast(joined), "sha", "left")
        .select("doc_id", keep.alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"),
                F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"))
    )
