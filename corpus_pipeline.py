"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, mixing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of `documents`; the last adds
the place in the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import decontam, mixing, neardup, quality, secretscan
from ledgerloom.llm.exchange import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or a learned rule go."""
    return quality.filtered(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    return neardup.one_of_each(docs).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secret spans are replaced by a mark and n_chars follows."""
    return secretscan.redacted(docs.select(COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; slot and block_offset order the interleaved stream."""
    return mixing.mix(docs, keep=COLUMNS)


STAGES = [("quality_rules", keep_quality), ("near_duplicates", keep_one_of_each), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("mixing", mix_sources)]
ORACLE_SQL = None  # the learned rules have no SQL form; tests compare the stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
