"""Scans of folders of files by name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shortest_paths(names: DataFrame, folder: str) -> DataFrame:
    """name, path, extension: for each name the file of the folder whose name begins with it, the shortest (first by name
    on ties), and its last four characters. Contents are not read; names without a file are left out."""
    files = names.sparkSession.read.format("binaryFile").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    # a file is met by its beginnings, of the lengths that names have
    lengths = names.select(F.length("name").alias("n")).distinct()
    files = files.join(F.broadcast(lengths.groupBy().agg(F.collect_set("n").alias("ns"))))  # one row
    files = files.select("path", "file", F.explode("ns").alias("n")).where("length(file) >= n").withColumn("name", F.expr("left(file, n)"))
    best = files.join(names.select("name").distinct(), "name").groupBy("name").agg(F.min(F.struct(F.length("file").alias("n"), "file", "path")).alias("b"))
    return best.select("name", "b.path", F.right("b.file", F.lit(4)).alias("extension"))
