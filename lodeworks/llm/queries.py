"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeworks.llm import bpe, license_scan, line_dedup, oracles, packing, quality_gam, quality_rules, secret_scan, simhash, topk, warc
from lodeworks.llm.common import spread_table, table


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_report(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(spread_table(spark, sf_dir, "documents"))


def op4_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.score(spread_table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.report(spread_table(spark, sf_dir, "pages"), min_bytes=0)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group_report(spread_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(table(spark, sf_dir, "documents"), runs=True)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread_table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model)


QUERIES = {
    f.__name__: f
    for f in (
        op1_topk, op2_bpe, op3_secret_scan, op4_quality_gam, op5_packing,
        op6_warc, op7_simhash, op8_license_scan, op9_line_dedup, op10_quality_rules,
    )
}
ORACLES = {
    "op1_topk": oracles.OP1,
    "op6_warc": oracles.OP6,
    "op8_license_scan": oracles.op8(license_scan.template_rows(), license_scan.MIN_PERCENT),
    "op9_line_dedup": oracles.OP9,
}
