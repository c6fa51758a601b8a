"""Driver queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parchment.llm import (
    bpe,
    chat_format,
    decontam,
    dual_tree,
    exact_dedup,
    langid,
    merkle,
    order_minhash,
    sharding,
    simhash,
    surrogates,
    tokencount,
    toxicity,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A secret of the run; a real one comes from the caller.
SURROGATE_KEY = b"surrogates of the given tables"
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document, boundary-crossing ones by the majority of their characters."""
    return tokencount.section_counts(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place among 64 shards."""
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each participant; mask spans as text."""
    return chat_format.with_digest(chat_format.perspectives(_table(spark, sf_dir, "conversations")))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.pseudonymize(_table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op11_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(_table(spark, sf_dir, "documents"))


def op12_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    return dual_tree.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


REGISTRY = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_decontamination,
        op3_language_id,
        op4_toxicity,
        op5_token_counts,
        op6_sharding,
        op7_exact_dedup,
        op8_chat_format,
        op9_pii_surrogates,
        op10_bpe,
        op11_order_minhash,
        op12_dual_tree,
        op13_merkle,
    )
}
