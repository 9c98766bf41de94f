"""A corpus from raw documents to packed sequences: each stage calls one operator of quillpanel.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillpanel.llm import near_copies as near, packing, pii, quality_rules, suffix_dedup
from quillpanel.llm.common import discard_but, durable, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.filter_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies: five-word shingles of similarity 0.8 or more.

    SimHash and Golay keys propose, MinHash keys reach the pairs that 64-bit fingerprints cannot; see near_copies.py.
    """
    return near.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that repeated 200-byte strings cover."""
    return suffix_dedup.remove_repeats(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.mask(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of the training window."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", rules),
    ("simhash_near_dedup", near_copies),
    ("suffix_array_dedup", repeats),
    ("pii", private),
    ("packing", packed),
]

#: Components of near-copies and byte spans need steps that SQL can't express; tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between stages the rows are written where every executor reads them."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), written()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = durable(docs)
            discard_but(spark, before, docs)
    return docs
