"""The corpus pipeline: documents to mixed, encoded training text, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of documents. The last has a row for each copy that the mix takes.

Nulls, empty and very long texts, ties, repeated rows and extra columns (whatever their names) are what the stage's operator makes
of them: null text counts as empty, which fails the base rule of quality; null languages and sources are groups of their own; of
equal rows one stays after the second stage; extra columns pass through all stages. Empty tables pass through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from torrentia.llm import bpe_codec, exact_dedup, near_dedup, quality_rules, source_mix
from torrentia.llm.common import discard, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a value equal to its threshold is kept."""
    return quality_rules.filter_quality(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with most code points, then the least doc_id; of rows that agree in all, one."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the least doc_id."""
    return near_dedup.deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: round(taken / size) times, halves up; empty ones never."""
    return source_mix.mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of them and of the decoded text; columns of these names are replaced."""
    return bpe_codec.encoded(docs, bpe_codec.default_vocabulary(), drop=("text", "n_chars"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mixing", mixing), ("encoding", encoding)]

#: Near duplicates and BPE have no SQL; tests/llm/test_pipeline.py holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
