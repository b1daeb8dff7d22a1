"""The corpus pipeline: quality rules, line dedup, near-dedup, secret redaction, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents; n_chars follows the text.

Defined cases: null and empty texts have no words, so the first stage rejects them; rows with one id go or stay by the rules of each
stage's operator; an empty table gives no rows at every stage; columns beyond those of documents stay up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mendframe.llm import line_dedup, minhash, packing, quality, secrets
from mendframe.llm.common import documents, table


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; the documents stay."""
    return _counted(line_dedup.dedup_lines(docs, min_docs=10))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate group stays: five-word shingles, similarity 0.8."""
    return minhash.keep_first(docs, width=5, percent=80)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become their kind in angle brackets."""
    return _counted(secrets.redact(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in as few sequences as best fit finds. Workers of other stages stay beside its own, so its cache is small and goes with the task."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), size=2048, end_id=0, cached=100_000, keep=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", packed),
]

#: The outlier rule, the join and the tokenizer are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages a written table."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = table(docs, name)
    return docs
