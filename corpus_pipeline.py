"""From raw documents to packed training sequences.

Five stages, each reading what the one before it kept: documents that the
quality classifier rejects go; of equal texts the one with the largest id
stays; of near-duplicates the one with the smallest id stays; secrets are
masked; the rest is packed into token sequences. ``run`` writes every
stage's result as Parquet under the shared checkpoint folder and reads it
back, so no later stage computes an earlier one again.

Cases are those of the operators; an empty table gives an empty packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chartwise.llm import exact_dedup, minhash, packing, quality, secret_scan
from chartwise.llm.common import save, table
from chartwise.llm.queries import JSON_FILE, RANK_FILE


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, JSON_FILE, RANK_FILE)


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", best_fit_packing),
]

#: Trained models, hashed sketches and a tokenizer have no SQL form; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
