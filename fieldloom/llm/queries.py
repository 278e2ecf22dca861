"""Queries of this subpackage over the given tables, and the SQL that DuckDB can hold against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm import automaton, chat, decontam, digest, license_scan, mixing, periodic, quality, secret_scan, sketch_join, spelling, token_counts, toxicity
from fieldloom.operators.shared import spread, table

#: Weights of op1 and of the pipeline's last stage; names without one weigh 1.
WEIGHTS = {"domain": {"domain0": 3.0, "domain1": 2.0}, "lang": {"en": 2.0}, "source": {"src0": 0.5}}
SHARE = 0.5


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "lang", "source").select("doc_id", "lang", "source", mixing.word_count(F.col("text")).alias("n_tokens"))
    docs = docs.withColumn("domain", mixing.domain(F.col("source")))
    return mixing.mix_sources(docs, WEIGHTS, share=SHARE).select("doc_id", "domain", "lang", "source", "n_tokens", "epoch")


def op2_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_chain(documents(spark, sf_dir), table(spark, sf_dir, "labels"), toxicity.given_categories(), "toxic")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(documents(spark, sf_dir, "source"))
    return found.select("doc_id", "source", F.explode("found").alias("f")).select("doc_id", "source", "f.*")


def op4_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"), quality.given_grade(), 3)


def op5_chat_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(chat.chat_examples(turns.union(extra)))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path())


def op7_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_fingerprints(documents(spark, sf_dir))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join.near_duplicates(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(documents(spark, sf_dir), slip=199))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(periodic.periodic_runs(periodic.planted(documents(spark, sf_dir))))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.round_trip(documents(spark, sf_dir), tokenizer_path())


QUERIES = {
    f.__name__: f
    for f in (
        op1_source_mixture, op2_toxicity_chain, op3_secret_scan, op4_quality_grades, op5_chat_examples, op6_token_counts,
        op7_quartile_digest, op8_jaccard_join, op9_decontamination, op10_license_scan, op11_spelling_variants,
        op12_periodic_runs, op13_bpe_round_trip,
    )
}

_CONTROL = r"(</?s|\[/?INST)(\\*)([>\]])"

ORACLES: dict[str, str] = {
    "op5_chat_examples": rf"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p as (
  select *, role = 'assistant' as mine,
    17 + length(regexp_replace(role, '{_CONTROL}', '\1\2\\\3', 'g')) + length(regexp_replace(text, '{_CONTROL}', '\1\2\\\3', 'g')) as chars,
    row_number() over (partition by conv_id order by turn desc, role desc, text desc) = 1 as last from t),
c as (select *, sum(chars) over (partition by conv_id order by turn, role, text rows unbounded preceding) as upto from p)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (mine), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (mine), '')) as loss_sha256,
  sum(upto) filter (mine or last)::bigint as formatted_chars,
  count(*) filter (mine or last)::bigint as n_examples
from c group by conv_id""",
}
