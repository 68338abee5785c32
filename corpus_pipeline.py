"""Corpus pipeline: quality classifier, exact dedup, SimHash near-dedup, best-fit packing.

Each stage takes what the one before kept, written as Parquet and read again, and returns the columns of documents; the
last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fairway.llm import exact_dedup, importance, packing, simhash
from fairway.llm.bpe import VOCABULARY
from fairway.llm.common import bounded, materialise, sweep, table, tables


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return importance.resample(docs, table(spark, sf_dir, "labels")).where("__kept").select(docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    bounded(spark)
    return exact_dedup.exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates (5-word shingles, similarity 0.8), the document with the smallest doc_id stays."""
    bounded(spark)
    return simhash.near_dedup(docs, words=5, similarity=0.8)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    bounded(spark)
    return packing.pack(docs, VOCABULARY, capacity=2048, end=0)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("simhash near-dedup", near), ("best-fit packing", packed)]

#: SQL has neither the classifier nor the fingerprints; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of `sf_dir`; the tables behind a stage go once its result is written, other queries' stay."""
    docs = table(spark, sf_dir, "documents")
    with tables() as own:
        for name, stage in STAGES[:-1]:
            docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
            sweep(spark, own, docs)
        return STAGES[-1][1](spark, docs, sf_dir)
