"""The corpus pipeline: documents through five operators, each stage written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orderflow.llm import decontaminate, near_copies, pieces, quality_rules, secret_scan, simhash
from orderflow.llm._shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current rule policy rejects go."""
    return quality_rules.keep_documents(docs, "v1")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, by SimHash of five-word shingles with pigeonring and what it cannot sift by bands, stays: the one with the smallest id."""
    return simhash.drop_near_duplicates(docs, classes=near_copies.near_copy_classes)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of the benchmark go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secret_scan.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the decoded text."""
    outputs = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return pieces.encode_pieces(docs, pieces.model_bytes(), outputs)


STAGES = [
    ("quality_rules", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("encoding", encoding),
]

#: SQL can express neither 64-bit XXH64 fingerprints nor the tokenizer; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
