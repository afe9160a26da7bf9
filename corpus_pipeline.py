"""The corpus pipeline: quality rules, line dedup, near-dedup, secret redaction, packing.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again as the next stage's
documents. All but the last return the columns of documents. Once a stage's result is written, the tables that it made on
the way and its predecessor's result are deleted, so the shared folder holds two stages at most.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodeworks.llm import line_dedup, packing, quality_rules, secret_scan, simhash
from lodeworks.llm.common import remove, table
from lodeworks.storage import settled


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.filter_documents(docs, model)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common lines go; every document stays."""
    return line_dedup.drop_common_lines(docs, min_docs=10, min_chars=1)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.drop_near_copies(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; every document stays."""
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_copy_stage),
    ("secret_scan", secret_stage),
    ("packing", packing_stage),
]

#: SQL has neither the trained labeller nor the fingerprints and ids; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = settled(partial(stage, spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            remove(before)
        before = docs
    return docs
