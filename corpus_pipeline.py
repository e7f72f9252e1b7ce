"""The corpus pipeline: quality, near copies, benchmark passages, personal data, packing.

Each stage takes what the one before kept, calls one operator, and returns documents with their columns; the last one
returns packed pieces. Stages are written as Parquet and read again, so a lost executor costs no finished stage.

Null and empty texts: scored by the classifier's bias alone; all of them are copies of one, which stays; they hold no
item and no personal data; packed as one end id. Rows that share a doc_id, or have none, are rows of their own in each
stage (of copies the one with the smallest id stays, one without an id before the others). Very long texts are read
whole. Other columns pass through, whatever their names. No documents: no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from galleon.llm import base, decontaminate, packing, pii, quality, simhash


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, base.table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays: of the SimHash operator's components, and of what an
    exact similarity joins to them."""
    return simhash.drop_copies(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, base.table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask_pii(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences."""
    return packing.pack(docs)


STAGES = [("quality", good), ("near_dedup", single), ("decontaminate", unseen), ("pii", private), ("packing", packed)]
#: Trained models, near copies and tokenizers can't be expressed in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = base.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = base.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
