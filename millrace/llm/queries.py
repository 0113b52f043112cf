"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.ann import nearest_every
from millrace.llm.decontaminate import contamination
from millrace.llm.langid import language_id
from millrace.llm.mixing import mix
from millrace.llm.paragraphs import paragraph_report
from millrace.llm.pii import pseudonymise
from millrace.llm.simhash import simhash_groups
from millrace.llm.suffix import remove_repeats
from millrace.llm.tokens import tokens_roundtrip
from millrace.llm.toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), "key of the registered query").drop("lang", "source", "n_chars")


def op3_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_report(table(spark, sf_dir, "documents"))


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens_roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", mixed.draws["shard"].alias("shards"), mixed.draws["place"].alias("places"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_every(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_pii, op3_paragraphs, op4_suffix, op5_language, op6_toxicity, op7_tokens, op8_simhash, op9_mixing, op10_neighbours)}


def oracle_sql() -> dict[str, str]:
    return {}
