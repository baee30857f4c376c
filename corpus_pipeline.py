"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm import decontaminate, langid, packing, secrets, simhash_dedup
from tracewright.llm._common import read, stash

#: Least calibrated probability of the predicted language; with less, the language isn't clear.
LEAST_SCORE = 0.4


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the language is clear; those without letters (null and empty texts among them) or below LEAST_SCORE go.

    Rows that repeat stay or go together; all columns stay, whatever their names; no rows give no rows. So it is in the stages below.
    """
    return langid.select_clear(docs, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: five-word shingles, similarity 0.8 or more.

    Of repeated rows one stays; a null id is never the smallest; texts without words are copies of each other.
    """
    return simhash_dedup.deduplicate(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks; a null or empty text holds none, and an empty benchmark leaves all."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def secret_values(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their live-looking secrets replaced; null and empty texts, and examples that many sources hold, stay as they are."""
    return secrets.redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences of all documents; a null or empty text is its end id alone, and repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secret_scan", secret_values),
    ("packing", sequences),
]

#: None of the stages can be put in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table; the stages before it are written to the shared folder. Edge cases are each stage's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
