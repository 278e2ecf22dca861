"""Small helpers that every module may use: reading tables, cutting lineage, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when counting it showed at most so many narrow rows (about 16 MB of ids).
BROADCAST_ROWS = 1_000_000
#: Narrow rows that one task of an iterative stage takes, and the tasks that it has at least.
ROWS_A_TASK, LEAST_TASKS = 50_000, 8
#: Rows of whole texts that a task holds at a time.
BATCH_ROWS = 1_024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of few files over all cores: its rows are dealt anew if it has fewer partitions than the cluster has cores.

    For heavy work on whole texts; tables of many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_batches(spark: SparkSession) -> None:
    """Let tasks read and hand to Python at most BATCH_ROWS rows of whole texts at a time.

    Spark's own batches (4,096 and 10,000 rows) take tens of megabytes of text each, in the JVM and again in Python.
    Batches that the user has set smaller stay.
    """
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"):
        if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
            spark.conf.set(key, str(BATCH_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df in as few partitions as its counted (or bounded) number of narrow rows needs; never in more than it has.

    A loop over a small table else writes one shuffle and one checkpoint file a partition in every round.
    """
    n = LEAST_TASKS + rows // ROWS_A_TASK
    return df.coalesce(n) if n < partitions(df.sparkSession) else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Without that setting a local master gets a folder of its own (tests); on a cluster it is an error, as no folder of
    one machine would do.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="fieldloom-")
    return _local


_local: str | None = None


def checkpoint(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and cut its lineage."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder, its lineage cut: for many rows, of which checkpoint() writes several
    times the bytes. The table stays as long as the folder does."""
    out = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def keep_ids(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join of wide rows with narrow ids, which are computed once; they are broadcast only if counted to be few."""
    ids = checkpoint(ids.select(on).distinct())
    few = ids.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, on, how)
