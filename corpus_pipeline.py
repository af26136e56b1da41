"""Corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

Stages but the last return the columns of `documents`; the last returns one row per kept
document: doc_id, n_tokens, ids_sha256, decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, common, decontaminate, exact_dedup, language_id, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (null, or without a letter) go; the language found replaces lang. Where no row has a
    label to learn from, documents with a letter stay as they are."""
    model = language_id.learn(docs.where(~common.held_out(F.col("doc_id"), 5, 0)))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(COLUMNS)
    found = language_id.predict(docs, model, carry=("text", "source", "n_chars")).where("lang_pred <> 'und'")
    return found.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays (null lowest); rows with different texts all stay, whatever their ids."""
    return exact_dedup.survivors(docs, ("lang", "source", "n_chars")).select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays (null last); no other row goes, whatever its id."""
    rows = common.numbered(docs.select(COLUMNS))
    return common.without(rows, simhash.surplus(rows))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, no others, whatever their ids."""
    rows = common.numbered(docs.select(COLUMNS))
    found = decontaminate.leaks(rows.select(F.col("uid").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return common.without(rows, found.select(F.col("doc_id").alias("uid")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", identify_language), ("exact dedup", drop_copies), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks), ("byte-level BPE", tokenize)]

#: A learned language classifier, SimHash and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.table(docs)
    return docs
