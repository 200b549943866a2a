"""Corpus pipeline: quality classifier, exact dedup, near dedup, personal data, packing, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.bpe import tokenizer_path
from gridloom.llm.common import keep, read
from gridloom.llm.exact_dedup import drop_copies
from gridloom.llm.near_dedup import drop_near_copies
from gridloom.llm.packing import pack_documents
from gridloom.llm.pii import redact
from gridloom.llm.quality import drop_rejected


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects (score below 0.5) go; it learns from the labels of rows not held out."""
    return drop_rejected(docs, read(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased) the row with the largest doc_id stays."""
    return drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked near-duplicates the row with the smallest doc_id stays."""
    return drop_near_copies(docs)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the text is replaced by its kind in angle brackets, and n_chars follows; no document goes."""
    return redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents with their places in sequences of at most 1024 tokens."""
    return pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("personal_data", privacy_stage),
    ("packing", packing_stage),
]

#: SQL cannot express the learned stages; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each result is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = keep(docs, name)
    return docs
