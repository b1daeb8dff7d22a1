"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, embeddings, fmindex, induced, line_dedup, minhash, packing, quality, secrets, toxicity
from .common import documents


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return induced.suffix_digest(documents(spark, sf_dir), window=100)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(documents(spark, sf_dir))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0)


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(documents(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.substring_digest(documents(spark, sf_dir), window=50)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), width=2, percent=80)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(documents(spark, sf_dir), min_docs=10)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir)).drop("distance")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.train(docs, documents(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_secret_scans, op3_best_fit_packing, op4_embedding_near_dedup, op5_substring_dedup, op6_byte_bpe, op7_minhash_near_dedup, op8_line_dedup, op9_quality_rules, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_array_dedup": induced.ORACLE, "op4_embedding_near_dedup": embeddings.ORACLE, "op5_substring_dedup": fmindex.ORACLE, "op7_minhash_near_dedup": minhash.ORACLE, "op8_line_dedup": line_dedup.ORACLE}
