"""Incremental operators on Structured Streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.operators.cluster import svm


def stream_of(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def histogram(rows: DataFrame, bin_col: str, value: str | None = None) -> DataFrame:
    """Counts (or sums of a value) by bin, kept up to date: use in update or complete mode."""
    agg = F.count("*") if value is None else F.sum(value)
    return rows.groupBy(F.col(bin_col).alias("bin")).agg(agg.alias("h"))


def windowed_histogram(rows: DataFrame, ts: str, bin_col: str, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Counts by time window and bin; rows later than the watermark are dropped by Spark, so state stays bounded."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(bin_col).alias("bin")).agg(F.count("*").alias("h"))


def warm_started_svm(stream: DataFrame, dims: int, state_path: str, checkpoint: str, lam: float = 0.1, rounds: int = 2) -> None:
    """Continue one linear SVM over micro-batches; (t, w) is kept in a table under state_path, one row a batch, so a
    restarted batch starts from its predecessor's state again."""
    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        w, t = None, 1
        if epoch:
            row = spark.read.parquet(f"{state_path}/epoch={epoch - 1}").first()
            w, t = list(row["w"]), row["t"]
        batch = batch.persist()
        w = svm(batch, dims, lam, rounds, w, t)
        spark.createDataFrame([(t + rounds, w)], "t int, w array<double>").write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
        batch.unpersist()

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def value_counts(stream: DataFrame, keys: list[str], idle_ms: int | None = None) -> DataFrame:
    """A multiset of values kept as keyed state: (keys, n, closed), a row for each value that a micro-batch touches.

    n is how often the value has been met since its state began. Rows are counted in their tasks first, so a hot value
    sends one row a batch; a value's state is one number, carried over restarts by the checkpoint. With idle_ms a value
    that is not met for so long gives its count once more, closed, and its state is dropped; it begins anew when it comes
    back, so totals are the closed counts and the newest open one (total_counts). Null parts of a value are a value of
    their own. keys must be columns of stream; its other columns are ignored. A query with idle_ms that only takes the
    available files ends only without micro-batches that have no data (spark.sql.streaming.noDataMicroBatches.enabled)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = stream.select(*keys)
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)

    def partial(frames):
        for df in frames:
            yield df.groupby(keys, dropna=False, sort=False).size().rename("m").reset_index()

    def carry(key, frames, state):
        n = state.get[0] if state.exists else 0
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(*key, n, True)], columns=[*keys, "n", "closed"])
            return
        n += int(sum(df["m"].sum() for df in frames))
        state.update((n,))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame([(*key, n, False)], columns=[*keys, "n", "closed"])

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    counted = rows.mapInPandas(partial, f"{kinds}, m long")
    return counted.groupBy(*keys).applyInPandasWithState(carry, f"{kinds}, n long, closed boolean", "n long", "update", timeout)


def total_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n) of all rows that value_counts has given so far, with the number of their micro-batch as epoch."""
    w = W.partitionBy(*keys).orderBy(F.desc("epoch"))
    last = rows.withColumn("_k", F.row_number().over(w))  # a row a micro-batch of a value
    own = F.when(F.col("closed") | (F.col("_k") == 1), F.col("n")).otherwise(0)
    return last.groupBy(*keys).agg(F.sum(own).alias("n"))
