"""From raw documents to packed training sequences: language, near copies, personal data, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents.  All stages but the last return the columns of
``documents``; the last one returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.langid import UNKNOWN, train, with_language
from pairwright.llm.minhash import without_copies
from pairwright.llm.mixing import mix_sources
from pairwright.llm.packing import pack
from pairwright.llm.pii import mask_pii
from pairwright.llm.scratch import small_batches, table, written

#: A language is taken as found if it covers this share of what it covers of its own texts, of a text's n-grams.
#: Of sf0.1's documents none has less than 0.55, and of texts of letters no language here writes none has more than 0.37.
COVERED = 0.45


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; null texts, texts without letters and those that no learned language covers go.

    Where no document says its language, nothing can be found and all go.
    """
    found = "_found"
    while found in docs.columns:
        found += "_"
    judged = with_language(docs, train(docs), as_col=found)
    return judged.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.covered") >= COVERED)).select(*docs.columns)


@small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id."""
    return without_copies(docs).select(*docs.columns)


@small_batches
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by the name of its kind, n_chars brought up to date."""
    return mask_pii(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@small_batches
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of sources takes it."""
    mixed = mix_sources(docs, keep=True)
    return mixed.where("mix_copies > 0").select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int")))).select(*docs.columns)


@small_batches
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    return pack(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("personal_data", personal_data), ("mixture", mixture), ("packing", packing)]

#: Trained filters, hashes and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
