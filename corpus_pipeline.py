"""Training-data pipeline over ``documents``: language, exact copies, near copies, personal data, packing.

Each stage takes what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemolake.llm import digest_index, language_id, minhash_dedup, packing, personal_data
from mnemolake.llm.shared import stored
from mnemolake.session import find_package, scratch_path

#: a clean text in two or three languages still scores above this; only noise that no language explains scores lower
MIN_SCORE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents in no language: without a letter, or below the least score."""
    find_package(spark)
    judged = language_id.identify_documents(docs)
    kept = judged.filter((F.col("lang_pred") != language_id.UNDECIDED) & (F.col("score") >= MIN_SCORE))
    return kept.select(*docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of those with the same text."""
    return digest_index.keep_first(docs, digest_index.DigestIndex(spark, scratch_path(spark, "pipeline-digests")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near copies."""
    find_package(spark)
    return minhash_dedup.keep_one(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; ``n_chars``, where there is one, follows."""
    clean = personal_data.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of at most 4096 tokens."""
    find_package(spark)
    pieces = packing.token_pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)
    return packing.pack(pieces.drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language", language), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("redact_pii", redact_pii), ("pack", pack),
]

#: language and token stages cannot be written in SQL; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
