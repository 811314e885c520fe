"""Joins that make many pairs of few bytes, laid out by shuffle partitions rather than by the bytes read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPLIT = 4  # parts of the left rows of one key


def parts(df: DataFrame) -> int:
    """Shuffle partitions of the session, for steps whose work isn't told by the bytes they read."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def met(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Inner join on keys. Both sides go to all shuffle partitions, as a few megabytes of rows can make millions of pairs
    and merging small partitions would leave them to a task or two. The left rows of a key stand in SPLIT parts, told by
    the hash of `by` (null: one part); the right rows stand in each. Null keys meet nothing.
    """
    n, keys = parts(left), [*keys, "_part"]
    here = left.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(SPLIT))).repartition(n, *keys)
    there = right.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPLIT - 1).cast("long")))).repartition(n, *keys)
    return here.join(there, keys).drop("_part")
