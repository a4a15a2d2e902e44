"""The corpus pipeline: language identification, exact and near deduplication, mixing, tokens.

Every stage works on all rows that the one before it kept, and all but the last return the columns
of documents. Rows pass whole; a stage only drops or, when mixing, repeats them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pathloom.llm import exact_dedup, language_id, mixing, simhash, suffix_pieces
from pathloom.llm.common import gone_at_exit, shared_folder


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter, and those whose language the model leaves open."""
    return language_id.drop_unidentified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep one row, that with the largest doc_id."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies keep one row, that with the smallest doc_id."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each source to its target weight, in the order of the schedule; a document taken twice comes twice."""
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document: doc_id and a digest of ids and of the text decoded from them."""
    return suffix_pieces.token_digest(docs)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("sentencepiece", tokenize),
]

#: SQL can't express these models and hashes; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    gone_at_exit(spark, folder)
    return docs
