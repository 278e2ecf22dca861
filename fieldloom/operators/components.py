"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.shared import checkpoint, sized


def _min_by_node(e: DataFrame) -> DataFrame:
    return e.groupBy("u").agg(F.min("v").alias("m"))


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of an edge, the smallest node that it reaches.

    Every round is two aggregations and joins on the node (split by adaptive execution where one node is hot); the
    number of rounds grows with the logarithm of the longest path, the number of tasks with that of the edges. Rows with
    a null end are ignored, loops count as a node of their own. The graph is never collected.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    given = checkpoint(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    rows = given.count()
    given = sized(given, rows)
    nodes = given.select("u").union(given.select("v")).distinct().withColumnRenamed("u", "node")
    e = given.where("u <> v")
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _min_by_node(both).select("u", F.least("u", "m").alias("m"))
        e = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        e = sized(sized(e, rows).distinct(), rows)
        low = _min_by_node(e)
        joined = e.join(low, "u")
        e = joined.select("u", F.col("m").alias("v")).union(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        e = checkpoint(sized(sized(e, rows).distinct(), rows))
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return sized(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("component")), rows)
