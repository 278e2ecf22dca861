"""A corpus pipeline of five stages over documents, each on all that its predecessor kept.

Stage functions take (spark, docs, sf_dir) and return a DataFrame; run() writes each result as Parquet and reads it back
as the next one's docs.

In all stages: the first three decide by doc_id, so rows that share an id stay or go together, and a row without an id
stays, as no decision names it; repeated rows all stay or all go. Texts are read whole at any length; a null or empty one
has no words, so it is no duplicate and holds no window or secret, and its grade is that of the model without features.
Nulls in other columns stay nulls. An empty table gives an empty table. Columns beyond those of documents go along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import decontam, mixing, quality, secret_scan, sketch_join
from fieldloom.llm.queries import SHARE, WEIGHTS
from fieldloom.operators.shared import keep_ids, shared_folder, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects; those at the threshold stay, and all do without labels."""
    rated = quality.rate_quality(docs, table(spark, sf_dir, "labels"), quality.given_grade(), 3)
    return keep_ids(docs, rated.where("not keep"), "doc_id", "left_anti")


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group that links connect; documents without words all stay, and so
    do rows that repeat the kept id."""
    groups = sketch_join.near_duplicates(docs)
    return keep_ids(docs, groups.where("component_id <> doc_id"), "doc_id", "left_anti")


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a window of a benchmark item, with or without an id; none without items."""
    hits = decontam.decontamination(docs, table(spark, sf_dir, "benchmark"))
    return keep_ids(docs, hits.where("contaminated"), "doc_id", "left_anti")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every row stays, null texts as they are."""
    return secret_scan.redact(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Select documents to the target weights; with the columns domain, n_tokens and epoch (given ones of these names are
    replaced). A null lang or source is a branch of its own; rows without an id form one tie of their leaf."""
    docs = docs.withColumn("n_tokens", mixing.word_count(F.col("text"))).withColumn("domain", mixing.domain(F.col("source")))
    return mixing.mix_sources(docs, WEIGHTS, share=SHARE)


STAGES = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("secrets", secret_redaction),
    ("mixture", source_mixture),
]

#: Trained models, the join and the windows have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = f"{shared}/pipeline-{uuid.uuid4().hex}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
