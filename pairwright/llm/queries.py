"""The operators' queries over the provided tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from pairwright.llm import oracles
from pairwright.llm.alignment import align
from pairwright.llm.classifier import quality_query
from pairwright.llm.embedding import near_vectors
from pairwright.llm.langid import language_query
from pairwright.llm.minhash import near_copies
from pairwright.llm.mixing import mix_sources
from pairwright.llm.packing import pack
from pairwright.llm.pii import pii_digest
from pairwright.llm.quality import quality_rules
from pairwright.llm.scratch import small_batches, table
from pairwright.llm.search import search_query
from pairwright.llm.secrets import secret_digest
from pairwright.llm.suffix import repeat_digest
from pairwright.llm.toxicity import toxicity_query


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def op4_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"), percent=85)


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=tokenizer_path())


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_query(table(spark, sf_dir, "documents"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"), first=tokenizer_path(), second=tokenizer_path("piece_bpe_32k.model"))


QUERIES = {
    query.__name__: small_batches(query)
    for query in (
        op1_quality_rules, op2_toxicity, op3_pii, op4_near_copies, op5_vectors, op6_repeats, op7_packing, op8_secrets, op9_mixing, op10_language,
        op11_quality, op12_search, op13_alignment,
    )
} | {"pipeline": corpus_pipeline.run}

ORACLES = {
    "op1_quality_rules": oracles.QUALITY,
    "op4_near_copies": oracles.NEAR_COPIES,
    "op5_vectors": oracles.VECTORS,
    "op9_mixing": oracles.MIXING,
    "op12_search": oracles.SEARCH,
}
