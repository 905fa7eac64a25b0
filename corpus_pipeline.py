"""Corpus preparation: documents in, training sequences out.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns
of ``documents``. ``run`` writes every stage's result as Parquet to the shared
checkpoint folder and hands the stored rows to the next stage, so a lost
executor never repeats an earlier stage. Every stage holds for null texts and
ids, empty tables and extra columns as its operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crewlens.llm.common import materialize, table
from crewlens.llm.decontaminate import drop_leaks
from crewlens.llm.language_id import keep_identified
from crewlens.llm.packing import pack_documents
from crewlens.llm.pii import mask_personal_data
from crewlens.llm.simhash import keep_one_per_group


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter or with a rejected score go."""
    return keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return keep_one_per_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"), scaled=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return mask_personal_data(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length, one row each, with their ids.

    Workers of the other stages live on beside the encoder, so it keeps fewer pieces than it does alone.
    """
    return pack_documents(docs, memo_pieces=260_000)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: SQL has no word for the trained models and tokenizers; tests/llm hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the ``documents`` of ``sf_dir``."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
