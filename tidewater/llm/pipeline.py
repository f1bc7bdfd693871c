"""Corpus pipeline: five stages over ``documents``.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept. ``run``
writes each result as Parquet in the shared folder and reads it again, so a lost executor
never costs more than the stage at hand. Nulls, empty tables and extra columns pass through;
all stages but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import packing, pii, quality_rules, simhash, weak_labels
from .common import read, shared_dir
from .queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised scorer rejects go."""
    return weak_labels.keep(docs)


def quality_thresholds(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond the adaptive thresholds of their language and source go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity of 0.8 or more."""
    return simhash.keep_first(docs, width=5, similarity=0.8)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences of 4096 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_thresholds),
    ("simhash near-dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]
#: SQL can express neither the trained scorers nor the library's tokens; tests compare by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = read(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
