"""The flagship query: a pool of segments filtered, scored, compared and ranked for diversity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.vectors import assembled, blockwise, homogeneous_map, linear_score
from fieldloom.operators import rank, sets
from fieldloom.operators.shared import stored
from fieldloom.sources import bindings as B

#: Bias, then weights of the mapped features.
WEIGHTS = [0.2, 0.05, 0.02, 0.01, 0.04, 0.02, 0.01]


def ranked_documents(spark: SparkSession, sf_dir: str, least: int = 5, lam: float = 0.75) -> DataFrame:
    """image_id, segment_id, rank, value: word sets of documents, without small ones and near copies, by relevance and novelty."""
    m = stored(B.seg_sets(spark, sf_dir).where(F.size("x") >= least))  # used four times, and its texts are long
    pool = sets.dissimilar(m, m.select("image_id", "segment_id", F.size("x").cast("long").alias("n"), "energy"))
    mapped = blockwise(assembled("size", "energy"), [1, 1], [lambda x: homogeneous_map(x, 1, 0.4, "chi2"), lambda x: homogeneous_map(x, 1, 0.4, "intersection")])
    scored = pool.select("image_id", "segment_id", linear_score(mapped, WEIGHTS).alias("score"))
    return rank.diversified_sets(scored, m, lam).withColumn("value", F.round("value", 6))
