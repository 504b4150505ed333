"""A corpus pipeline: quality, near-duplicates, benchmark passages, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor
kept; ``run`` writes what a stage returns as Parquet in the shared folder and reads
it again for the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import decontam, packing, quality, simhash
from codeloom.llm.common import table
from codeloom.llm.queries import tokenizer_path
from codeloom.session import stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It is trained on the labelled
    ones among its input, outside the held-out fold."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies stays, that with the smallest id.

    Compared are shingles of five words at a similarity of 0.8 or more.
    """
    return simhash.keep_one_each(docs, simhash.NEAR_COPIES)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.Decontamination(docs, table(spark, sf_dir, "benchmark")).clean(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their place in sequences of 2048 tokens."""
    return packing.pack(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", neardup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# A learned score, fingerprints and a tokenizer are beyond SQL; tests/llm compares
# the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, work in STAGES:
        docs = stage(work(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
