"""Corpus pipeline: quality rules, line dedup, near-dedup, secret redaction, packing.

Every stage works on all that its predecessor kept. A stage's result is written as Parquet under
the shared checkpoint folder and read again, so a lost executor never repeats an earlier stage.
All stages but the last return the columns of the documents table; the last returns one row per
packed piece.

Defined results: documents with a null or empty text have no words and are rejected by the first
stage. Rows equal in doc_id and text pass the first two stages as often as they come in; near-dedup
keeps one row of them. Of near-duplicates that tie, the smallest doc_id stays. Very long texts are
whole in every stage; an empty table gives no rows; columns of any other names pass through to the
last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from custseg.llm import line_dedup, near_dedup, packing, quality, secrets
from custseg.llm.common import materialize
from custseg.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others go."""
    return quality.clean(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines that many documents share stay in one of them."""
    return line_dedup.drop_repeated_lines(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, 0.8) stays."""
    return near_dedup.first_of_each(docs, words=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

# BPE tokenization has no SQL form; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
