"""A corpus pipeline: quality rules, exact duplicates, near duplicates, repeated passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvaframe.llm import exact, near, packing, quality, repeats
from sylvaframe.llm.common import passing, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest id."""
    return exact.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of at least 0.8), the document with the smallest id."""
    return near.drop_near_copies(docs)


def repeat_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has."""
    return repeats.drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's tokens in sequences of several lengths."""
    return packing.best_fit(packing.token_lengths(docs, remembered=packing.REMEMBERED))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("repeat_dedup", repeat_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express these stages; the tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; each result is written to the shared folder and read again, and what it was made from is deleted."""
    docs = table(spark, sf_dir, "documents")
    with passing(spark):
        for name, stage in STAGES[:-1]:
            with passing(spark):
                docs = written(stage(spark, docs, sf_dir), name, stays=True)
        return written(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0], stays=True)
