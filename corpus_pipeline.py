"""The corpus pipeline: documents through five operators of lexarium.llm, in order.

Each stage works on what its predecessor kept. All but the last return the
columns of documents; the last returns the encoded documents. Every stage
decides row by row, so rows without a doc_id, or that share one, are kept,
dropped and scheduled by their own text; empty tables pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lexarium.llm import bpe_piece, curriculum, exact_cqf, near_copies, toxicity_subword
from lexarium.llm.common import table, written


def _bounded(spark: SparkSession) -> None:
    """Small batches between the JVM and Python, whose buffers stand outside the executors' heaps."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    _bounded(spark)
    return toxicity_subword.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal texts."""
    _bounded(spark)
    return exact_cqf.drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose five-word shingles have a Jaccard similarity of 0.8 or more."""
    _bounded(spark)
    return near_copies.drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, each as often as its source's target asks."""
    _bounded(spark)
    return curriculum.mixed_documents(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each document."""
    _bounded(spark)
    return bpe_piece.encoded(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("simhash near-dedup", near_dedup), ("mixing", mixing), ("byte-level bpe", byte_bpe)]

#: The model of the first stage and the merges of the last can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage{k}")
    return docs
