"""Streams of upserts: an extension, since all else here is batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from shoal.sources import latest


def stream_latest(rows: DataFrame, keys: list[str], order: list[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``sink`` with one row a key, the last written."""
    return rows.writeStream.foreachBatch(lambda df, n: sink(latest(df, keys, order), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_first(rows: DataFrame, keys: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """First write wins within the watermark."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)
