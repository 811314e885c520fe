"""Counting points in intervals from prefix sums, without building a pair.

Points are first counted by value, so equal ones are one row. The number of points up to x is what stands in smaller
bands plus what stands up to x in x's own band; a band is a 64th of a doubling, so one holds few distinct values and a
key few bands, however many rows share the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHIFT = 6000  # small values share a band


def _band(x: Column) -> Column:
    return F.floor(F.log2(F.greatest(x, F.lit(0)).cast("double") + SHIFT) * 64)


def disjoint(spans: Column) -> Column:
    """An array of struct(lo, hi) of whole numbers as disjoint ones, in order; empty and null ones go."""
    real = F.array_sort(F.filter(spans, lambda s: s["lo"] <= s["hi"]))
    none = F.array().cast("array<struct<lo:bigint,hi:bigint>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        grown = F.struct(last["lo"].cast("long").alias("lo"), F.greatest(last["hi"], s["hi"]).cast("long").alias("hi"))
        own = F.array(F.struct(s["lo"].cast("long").alias("lo"), s["hi"].cast("long").alias("hi")))
        return F.when(F.coalesce(s["lo"] <= last["hi"] + 1, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, own))

    return F.aggregate(real, none, add)


def counted(points: DataFrame, asked: DataFrame, key: list[str], who: list[str]) -> DataFrame:
    """(who, n): points (key, x long) within asked's spans (who, key, spans: array of disjoint struct(lo, hi)), summed over keys.

    Askers without any point have n = 0; points without a value and null keys count nowhere.
    """
    values = points.where("x is not null").groupBy(*key, "x").agg(F.count("*").alias("n"))
    ends = asked.select(*who, *key, F.explode_outer("spans").alias("s"))
    ends = ends.select(*who, *key, F.explode_outer(F.when(F.col("s").isNotNull(), F.array(F.struct(F.lit(1).alias("sign"), F.col("s.hi").alias("x")), F.struct(F.lit(-1).alias("sign"), (F.col("s.lo") - 1).alias("x"))))).alias("e")).select(*who, *key, "e.sign", "e.x")
    wanted = ends.where("x is not null").select(*key, "x", F.lit(0).cast("long").alias("n")).distinct()
    both = values.unionByName(wanted).groupBy(*key, "x").agg(F.sum("n").alias("n")).withColumn("band", _band(F.col("x")))
    within = F.sum("n").over(Window.partitionBy(*key, "band").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bands = both.groupBy(*key, "band").agg(F.sum("n").alias("n")).withColumn("below", below).drop("n")
    upto = both.withColumn("within", within).join(bands, [*key, "band"]).select(*key, "x", (F.col("within") + F.col("below")).alias("upto"))
    return ends.join(upto, [*key, "x"], "left").groupBy(*who).agg(F.coalesce(F.sum(F.col("sign") * F.coalesce("upto", F.lit(0))), F.lit(0)).alias("n"))
