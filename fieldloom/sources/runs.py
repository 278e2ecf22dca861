"""Run-length label maps: lines "image label row start end"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def to_runs(lab: DataFrame) -> DataFrame:
    """image_id, label, row, start, end of each run of equal labels in a row."""
    w = W.partitionBy("image_id", "r").orderBy("c")
    new = (F.col("label") != F.lag("label", 1, -1).over(w)).cast("int")
    g = lab.select("image_id", "label", "r", "c", new.alias("new")).withColumn("run", F.sum("new").over(w))
    return g.groupBy("image_id", "label", "r", "run").agg(F.min("c").alias("start"), F.max("c").alias("end")).select("image_id", "label", F.col("r").alias("row"), "start", "end")


def write_runs(runs: DataFrame, path: str) -> None:
    runs.select(F.concat_ws(" ", "image_id", "label", "row", "start", "end").alias("value")).write.text(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", " ")
    return spark.read.text(path).select(p[0].alias("image_id"), *(p[i].cast("int").alias(n) for i, n in enumerate(("label", "row", "start", "end"), 1)))


def expand(runs: DataFrame) -> DataFrame:
    return runs.where("start <= end").select("image_id", F.col("row").alias("r"), F.explode(F.sequence("start", "end")).alias("c"), "label")


def audit(runs: DataFrame, grid: DataFrame, labels: int) -> DataFrame:
    """What is wrong with runs: labels of `labels` or more, runs outside the grid, pixels set twice or never."""
    px = expand(runs)
    bad = runs.where((F.col("label") >= labels) | (F.col("label") < 0)).select("image_id", F.col("row").alias("r"), F.col("start").alias("c"), F.lit("label").alias("what"))
    outside = px.join(grid, ["image_id", "r", "c"], "left_anti").select("image_id", "r", "c", F.lit("range").alias("what"))
    twice = px.groupBy("image_id", "r", "c").count().where("count > 1").select("image_id", "r", "c", F.lit("twice").alias("what"))
    never = grid.join(px, ["image_id", "r", "c"], "left_anti").select("image_id", "r", "c", F.lit("unassigned").alias("what"))
    return bad.union(outside).union(twice).union(never)
