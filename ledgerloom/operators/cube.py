"""Benchmark cube: releases computed from businesses, checked cell by cell and against the release before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of a line's share of revenue, of a cell's expense lines together and of margins; data quality; quorum
LINE_MAX, SUM_MAX = 8.0, 20.0
NET_MARGIN, GROSS_MARGIN = (-15.0, 1.5), (-0.5, 1.0)
QUALITY = ["A", "B", "C", "D", "E"]
QUORUM = "0.95"
KEYS = ["naics", "band", "cohort"]
REVENUE = "operating_revenue"


def release(businesses: DataFrame) -> DataFrame:
    """Lines of a release (KEYS, bucket, pct, q1, median, q3, businesses) from businesses (KEYS, business, bucket, amount, revenue); no revenue, no share."""
    share = F.when(F.col("revenue") > 0, F.col("amount").cast("double") / F.col("revenue").cast("double"))
    rows = businesses.withColumn("_p", share).where("_p is not null")
    q = F.percentile("_p", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*KEYS, "bucket").agg(F.avg("_p").alias("pct"), q.alias("q"), F.count("*").alias("businesses")).select(*KEYS, "bucket", "pct", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "businesses")


def _flags(*pairs: tuple[str, Column]) -> Column:
    return F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in pairs])))


def _outside(c: str, bounds: tuple[float, float]) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).between(*bounds)


def line_errors(lines: DataFrame) -> DataFrame:
    """(KEYS, bucket, error): shares that are missing, negative or over LINE_MAX; bands out of order. A band with one end alone isn't judged."""
    share = F.col("pct").isNull() | ~F.col("pct").between(0.0, LINE_MAX)
    ends = F.col("q1").isNotNull() & F.col("q3").isNotNull()
    order = ends & ((F.col("q1") > F.col("q3")) | (F.col("median").isNotNull() & ~F.col("median").between(F.col("q1"), F.col("q3"))))
    return lines.select(*KEYS, "bucket", _flags(("share", share), ("order", order)).alias("error"))


def cell_errors(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """(KEYS, error) of cells (KEYS, net_profit_margin, gross_margin, pct_profitable, quality): margins, share of profitable ones and quality out of range; expense lines of a cell over SUM_MAX together (only lines in range count)."""
    fair = F.col("pct").between(0.0, LINE_MAX) & (F.col("bucket") != REVENUE)
    total = lines.groupBy(*KEYS).agg(F.sum(F.when(fair, F.col("pct")).otherwise(0.0)).alias("_sum")).select(*KEYS, _flags(("line_sum", F.col("_sum") > SUM_MAX)).alias("error"))
    own = cells.select(*KEYS, _flags(("net_margin", _outside("net_profit_margin", NET_MARGIN)), ("gross_margin", _outside("gross_margin", GROSS_MARGIN)), ("profitable", _outside("pct_profitable", (0.0, 1.0))), ("quality", F.col("quality").isNotNull() & ~F.col("quality").isin(QUALITY))).alias("error"))
    return total.unionByName(own)


def compared(new: DataFrame, old: DataFrame) -> DataFrame:
    """(KEYS, change, n_new, n_old) of every cell of either release: added, removed, or kept, and lines in each."""
    n = lambda df, name: df.groupBy(*KEYS).agg(F.count("*").alias(name))
    both = n(new, "n_new").join(n(old, "n_old"), KEYS, "full")
    change = F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").otherwise("kept")
    return both.select(*KEYS, change.alias("change"), F.coalesce("n_new", F.lit(0)).alias("n_new"), F.coalesce("n_old", F.lit(0)).alias("n_old"))


def verdict(new: DataFrame, old: DataFrame, errors: DataFrame) -> DataFrame:
    """One row on a release: its cells, those of the one before, added, removed, errors, and why it is refused (empty, regressed, errors), if it is.

    A release of fewer than QUORUM of the cells before is regressed, unless there were none before.
    """
    is_ = lambda c: F.count_if(F.col("change") == c)
    seen = compared(new, old).agg(is_("added").alias("added"), is_("removed").alias("removed"), is_("kept").alias("kept"))
    seen = seen.withColumn("n_new", F.col("kept") + F.col("added")).withColumn("n_old", F.col("kept") + F.col("removed"))
    bad = errors.agg(F.count("*").alias("n_errors"))
    less = F.col("n_new") < F.lit(QUORUM).cast("decimal(4,2)") * F.col("n_old")
    out = seen.crossJoin(F.broadcast(bad))  # one row each
    why = F.array_join(F.array_compact(F.array(F.when(F.col("n_new") == 0, F.lit("empty")), F.when(less, F.lit("regressed")), F.when(F.col("n_errors") > 0, F.lit("errors")))), ",")
    return out.select("n_new", "n_old", "added", "removed", "n_errors", why.alias("refused_for"))


def anchored(lines: DataFrame, anchor: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(KEYS, bucket, expected, pct) of anchor lines (KEYS, bucket, expected) that a release lacks or that differ by more than the tolerance."""
    out = anchor.join(lines.select(*KEYS, "bucket", "pct"), [*KEYS, "bucket"], "left")
    return out.where(F.col("pct").isNull() | (F.abs(F.col("pct") - F.col("expected")) > tolerance)).select(*KEYS, "bucket", "expected", "pct")
