"""Conversion by the quote of the day: the last one at or before a row's day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_day(days: DataFrame, quotes: DataFrame) -> DataFrame:
    """(currency, day, rate, as_of) for each distinct (currency, day) of days: quotes are carried forward day by day.

    Rows are reduced to their days before anything is ordered, so what one task orders is a currency's calendar. Of
    several quotes of a day the largest counts; days before a currency's first quote have a null rate.
    """
    asked = days.select("currency", "day").where("currency is not null and day is not null").distinct()
    said = quotes.where("rate is not null").groupBy("currency", "day").agg(F.max("rate").alias("rate"))
    both = asked.withColumn("asked", F.lit(True)).join(said, ["currency", "day"], "full")
    w = Window.partitionBy("currency").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("rate").isNotNull(), F.struct("rate", F.col("day").alias("as_of"))), ignorenulls=True).over(w)
    return both.withColumn("q", last).where("asked").select("currency", "day", "q.rate", "q.as_of")


def converted(rows: DataFrame, quotes: DataFrame, amount: str, base: str = "CAD", places: int = 2) -> DataFrame:
    """rows (currency, day date, amount) with rate, as_of and in_base; the base currency has rate 1, a currency or day without a quote nulls."""
    table = by_day(rows.where(F.col("currency") != base), quotes)
    own = F.col("currency") == base
    out = rows.join(table, ["currency", "day"], "left")
    one = F.lit("1").cast(quotes.schema["rate"].dataType)
    out = out.withColumn("rate", F.when(own, one).otherwise(F.col("rate"))).withColumn("as_of", F.when(own, F.col("day")).otherwise(F.col("as_of")))
    return out.withColumn("in_base", F.round(F.col(amount) * F.col("rate"), places).cast("decimal(18,2)"))


def missing(rows: DataFrame, quotes: DataFrame, base: str = "CAD") -> DataFrame:
    """Currencies of rows that have no quote at all."""
    asked = rows.where((F.col("currency") != base) & F.col("currency").isNotNull()).select("currency").distinct()
    return asked.join(quotes.where("rate is not null").select("currency").distinct(), "currency", "left_anti")
