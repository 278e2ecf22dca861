"""Stages that are materialized once: finished keys are read, the others computed and appended."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame


def materialize_once(df: DataFrame, compute, key: str, path: str) -> DataFrame:
    """compute(df) by key, kept in Parquet under path; keys that are there already are not computed again."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
    except AnalysisException:  # nothing there yet
        done = None
    left = df if done is None else df.join(done, key, "left_anti")
    compute(left).write.mode("append").parquet(path)
    return spark.read.parquet(path)
