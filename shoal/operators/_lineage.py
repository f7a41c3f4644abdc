"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the session's spark.checkpoint.dir (a temporary folder only where that is unset)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="shoal-"))
    return df.checkpoint()


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="shoal-")
    return f"{root.rstrip('/')}/shoal-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the same folder and read again: a fraction of a checkpoint's size, for tables that are read several times."""
    spark = df.sparkSession
    path = shared_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def shared_file(path: str, mode: str):
    """A binary stream to or from a file of the shared folder, wherever that is."""
    system, inner = _filesystem(path)
    if mode == "rb":
        return system.open_input_stream(inner, compression=None)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def remove(path: str) -> None:
    """A folder of the shared folder goes, if it is there."""
    system, inner = _filesystem(path)
    if system.get_file_info(inner).type.name == "Directory":
        system.delete_dir(inner)
