"""Shared plumbing: the shared work folder, lineage cuts, folds and samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are learnt from when crc32(doc_id) mod FOLDS is not 0.
FOLDS = 5

_own_dirs: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """A fresh path in the folder all executors share.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is
    unset on one machine (tests) a temporary folder takes its place; on a cluster
    that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _own_dirs[app] = _own_dirs.get(app) or tempfile.mkdtemp(prefix="shoal-")
    return f"{root.rstrip('/')}/shoal-{uuid.uuid4().hex}"


def gathered(df: DataFrame, a_core: int = 2) -> DataFrame:
    """``df`` in at most some ``a_core`` partitions a core, so that it is written to as many files.

    A file for each partition may be thousands of tiny ones, and each costs the file
    system, and the executor that opens it, more than its rows: Hadoop's local file
    system starts processes from the executor for each. A task then goes through
    several partitions one after the other.
    """
    spark = df.sparkSession
    return df.coalesce(max(a_core * spark.sparkContext.defaultParallelism, partitions(spark) * a_core // 32))


def materialise(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Lost executors then cost no recomputation of what lies before, and several
    readers share one computation. At most some eight files a core are written, or
    two of a ``narrow`` table (a few numbers a row).
    """
    path = work_dir(df.sparkSession)
    gathered(df, 2 if narrow else 8).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores as it takes for ``df`` not to have them."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the fold that no classifier learns from (null ids: not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def distinct_texts(docs: DataFrame, labels: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """The distinct texts of the learning folds: h (hash of the text), doc_id, y.

    ``y`` is the label (the highest, where equal texts or repeated label rows differ),
    null without one; a string label is taken from ``docs`` itself if ``labels`` is
    None. Equal texts count once, so a large group of copies cannot fill a sample.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    h = F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    if labels is None:
        rows = rows.select("doc_id", h, (F.col(label) if label else F.lit(None).cast("int")).alias("y"))
    else:
        y = labels.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
        rows = rows.select("doc_id", h).join(y, "doc_id", "left")
    return materialise(rows.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.max("y").alias("y")), narrow=True)


def pick(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Texts of the chosen (doc_id, y); ``chosen`` is bounded by its sample size, so it is broadcast."""
    chosen = materialise(chosen.select("doc_id", "y"), narrow=True)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])


def ranked(texts: DataFrame, per_label: int) -> DataFrame:
    """The ``per_label`` rows of smallest hash of each label."""
    w = Window.partitionBy("y").orderBy("h", "doc_id")
    return texts.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_label).drop("nth")


def shared_file(path: str, mode: str):
    """A binary stream to or from a file of the shared folder, wherever that is."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    if mode == "rb":
        return system.open_input_stream(inner, compression=None)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)
