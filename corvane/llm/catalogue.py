"""The queries opN_<name> over the provided tables, and their DuckDB oracles where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corvane.llm import bpe, chat, classifier, divergence, fingerprints, minhash, mixing, periodic, quality, repeats, secrets, sharding, simhash
from corvane.llm.common import documents


#: The rank file that the BPE query encodes by, a name of public_tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(documents(spark, sf_dir))


def op2_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_table(documents(spark, sf_dir))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_table(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(documents(spark, sf_dir), words=4, budget=4)


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir), 8)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_table(documents(spark, sf_dir))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_table(documents(spark, sf_dir))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_table(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, applied to documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_OPERATORS = (
    op1_mix_sources, op2_quality_mil, op3_secrets, op4_fingerprints, op5_byte_bpe, op6_chat, op7_repeats, op8_simhash, op9_shard, op10_quality_rules,
    op11_periodic_runs, op12_minhash, op13_divergence, pipeline,
)
QUERIES = {f.__name__: f for f in _OPERATORS}
ORACLES: dict[str, str] = {
    "op6_chat": chat.ORACLE,
    "op7_repeats": repeats.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_minhash": minhash.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
