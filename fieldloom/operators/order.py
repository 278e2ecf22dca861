"""Global ranks and running sums without putting all rows into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from fieldloom.operators.shared import checkpoint, partitions


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with its place (from 1) in a total order: rows are range-partitioned and sorted; one number a partition goes
    through the driver."""
    rows = checkpoint(df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order))
    rows = rows.withColumn("_p", F.spark_partition_id()).withColumn("_l", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    offset, total = {}, 0
    for p, n in sorted(tuple(r) for r in rows.groupBy("_p").count().collect()):
        offset[p], total = total, total + n
    table = F.create_map(*(F.lit(x) for kv in offset.items() for x in kv)) if offset else None
    base = table[F.col("_p")] if offset else F.lit(0)
    return rows.withColumn(name, (F.col("_l") + base + 1).cast("long")).drop("_p", "_l")


def running_sums(ranked: DataFrame, sums: dict[str, Column], rank: str = "rank", block: int = 4096) -> DataFrame:
    """Running totals in the order of rank: block totals first, then windows inside blocks of so many rows."""
    rows = ranked.withColumn("_b", F.floor((F.col(rank) - 1) / block))
    per = rows.groupBy("_b").agg(*(F.sum(c).alias(f"_s_{n}") for n, c in sums.items()))
    before = W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    per = per.select("_b", *(F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums))
    own = W.partitionBy("_b").orderBy(rank).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("*", *(F.sum(c).over(own).alias(f"_r_{n}") for n, c in sums.items())).join(per, "_b")
    return rows.select(*ranked.columns, *((F.col(f"_r_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums))
