"""Ordered computations: job queue, batches, running balances, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X


def _by_day(jobs: DataFrame, value: Column, fold, *order: str) -> DataFrame:
    """Adds _before: fold (a sum or maximum) of value over all earlier rows of the tenant, null for the first.

    Earlier days count as one value each and earlier rows of the day one by one, so no task orders a whole tenant, only
    its calendar. Rows without a time come first.
    """
    rows = jobs.withColumn("_v", value).withColumn("_day", F.coalesce(F.to_date(order[0]), F.lit("0001-01-01").cast("date")))
    inside = Window.partitionBy("user_id", "_day").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("user_id").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy("user_id", "_day").agg(fold("_v").alias("_all")).select("user_id", "_day", fold("_all").over(before).alias("_days"))
    both = F.array_compact(F.array("_days", "_rows"))
    joined = rows.withColumn("_rows", fold("_v").over(inside)).join(days, ["user_id", "_day"])
    total = F.array_max(both) if fold is F.max else F.when(F.size(both) > 0, F.aggregate(both, F.lit(0).cast("long"), lambda x, y: x + y))
    return joined.withColumn("_before", total).drop("_v", "_day", "_days", "_rows")


def queue_ahead(jobs: DataFrame) -> DataFrame:
    """Pending jobs before each pending one, by (created_at, position, id) within the tenant."""
    out = _by_day(jobs.where("status = 'pending'").select("user_id", "id", "created_at", "position"), F.lit(1).cast("long"), F.sum, "created_at", "position", "id")
    return out.select("user_id", "id", F.coalesce("_before", F.lit(0)).alias("ahead"))


def batches(jobs: DataFrame) -> DataFrame:
    """Gaps and islands: a batch starts where every earlier job had finished when the job arrived.

    jobs: user_id, id, created_at, finished_at (null while running).
    """
    done = F.coalesce("finished_at", F.lit("9999-12-31").cast("timestamp"))
    latest = F.col("_before")
    start = F.when(latest.isNull() | (latest <= F.col("created_at")), 1).otherwise(0).cast("long")
    marked = _by_day(jobs, done, F.max, "created_at", "id").withColumn("_s", start).drop("_before")
    return _by_day(marked, F.col("_s"), F.sum, "created_at", "id").withColumn("batch", F.coalesce("_before", F.lit(0)) + F.col("_s")).drop("_s", "_before")


def batch_summary(jobs: DataFrame) -> DataFrame:
    out = batches(jobs).groupBy("user_id", "batch").agg(F.min("id").alias("anchor"), F.count("*").alias("n"), F.count("finished_at").alias("finished"))
    return out


def latest_batch(jobs: DataFrame) -> DataFrame:
    out = batch_summary(jobs)
    return out.groupBy("user_id").agg(F.max_by(F.struct("batch", "anchor", "n", "finished"), "batch").alias("b")).select("user_id", "b.*")


def eta(jobs: DataFrame, slots: int = 4, last: int = 20) -> DataFrame:
    """Average of the last 20 finished jobs of a kind (a seed for none) times what is pending, over the slots."""
    w = Window.partitionBy("user_id", "kind").orderBy(F.col("created_at").desc(), F.col("id").desc())
    recent = jobs.where("status = 'done'").withColumn("k", F.row_number().over(w)).where(F.col("k") <= last).groupBy("user_id", "kind").agg(F.avg("seconds").alias("average"))
    pending = jobs.groupBy("user_id", "kind").agg(F.count_if(F.col("status") == "pending").alias("pending"))
    seed = F.create_map(*[v for k, s in X.ETA_SEED_SECONDS.items() for v in (F.lit(k), F.lit(s))])[F.col("kind")]
    out = pending.join(recent, ["user_id", "kind"], "left").withColumn("average", F.coalesce("average", seed))
    return out.groupBy("user_id").agg(F.sum("pending").cast("long").alias("pending"), (F.sum(F.col("average") * F.col("pending")) / slots).alias("eta_seconds"))


def rolling_eta(marks: DataFrame, last: int = 10, least: int = 3) -> DataFrame:
    """Rate over the last marks (run_id, at seconds, done, total) and the remaining time; null for fewer than three."""
    w = Window.partitionBy("run_id").orderBy("at").rowsBetween(-(last - 1), 0)
    n, span, made = F.count("*").over(w), F.max("at").over(w) - F.min("at").over(w), F.max("done").over(w) - F.min("done").over(w)
    rate = F.when((n >= least) & (span > 0), made / span)
    return marks.withColumn("rate", rate).withColumn("remaining", F.when(F.col("rate") > 0, (F.col("total") - F.col("done")) / F.col("rate")))


def statement_rows(txns: DataFrame) -> DataFrame:
    """Statement lines with a running balance, from ledger rows (fixture for the balance checks)."""
    signed = F.when(F.col("transaction_type") == "CREDIT", F.abs(S.money("amount"))).otherwise(-F.abs(S.money("amount")))
    w = Window.partitionBy("user_id", "source_file", F.substring("date_posted", 1, 7)).orderBy("date_posted", "id").rowsBetween(Window.unboundedPreceding, 0)
    drift = F.when(F.col("id") % 23 == 0, F.lit("1.00")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    return txns.select("user_id", "source_file", F.substring("date_posted", 1, 7).alias("month"), "id", "date_posted", "transaction_type", F.abs(S.money("amount")).alias("value"), "description", (F.sum(signed).over(w) + drift).cast("decimal(18,2)").alias("balance"))


def running_balance(rows: DataFrame, tolerance: str = "0.02") -> DataFrame:
    """Lines whose balance doesn't follow from the line before; more than 5% of a statement's lines is a fault."""
    w = Window.partitionBy("user_id", "source_file", "month").orderBy("date_posted", "id")
    signed = F.when(F.col("transaction_type") == "CREDIT", F.col("value")).otherwise(-F.col("value"))
    step = rows.withColumn("bad", F.abs(F.col("balance") - F.lag("balance").over(w) - signed) > F.lit(tolerance).cast("decimal(4,2)"))
    return step.groupBy("user_id", "source_file", "month").agg(
        F.count("balance").alias("checked"), F.count_if(F.coalesce("bad", F.lit(False))).alias("bad"), (F.count_if(F.coalesce("bad", F.lit(False))) * 20 > F.count("balance")).alias("inconsistent"),
    )


def statement_check(rows: DataFrame, opening: str = "0.00", card: bool = False) -> DataFrame:
    """Opening plus credits less debits (the other way on a card) against the last balance; flags and confidence tier."""
    w = Window.partitionBy("user_id", "source_file", "month")
    dup = rows.withColumn("again", F.count("*").over(Window.partitionBy("user_id", "source_file", "month", "date_posted", "value", F.substring("description", 1, 40))) > 1).withColumn("last", F.last("balance").over(w.orderBy("date_posted", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sign = -1 if card else 1
    signed = F.when(F.col("transaction_type") == "CREDIT", F.col("value")).otherwise(-F.col("value")) * sign
    out = dup.groupBy("user_id", "source_file", "month").agg(F.count("*").alias("n"), (F.sum(signed) + F.lit(opening).cast("decimal(18,2)")).cast("decimal(18,2)").alias("expected"), F.max("last").alias("closing"), F.bool_or("again").alias("duplicates"))
    off = F.abs(F.col("expected") - F.col("closing")) > F.lit("0.02").cast("decimal(4,2)")
    flags = F.array_join(F.array_compact(F.array(F.when(off, F.lit("balance_mismatch")), F.when(F.col("duplicates"), F.lit("possible_duplicates")), F.when(F.col("n") < 3, F.lit("few_rows")))), ",")
    tier = F.when(off, "LOW").when(F.col("duplicates") | (F.col("n") < 3), "MEDIUM").otherwise("HIGH")
    return out.withColumn("flags", flags).withColumn("tier", tier)


def first_of_duplicates(rows: DataFrame) -> DataFrame:
    """The first line of each (date, amount, start of description) in a statement."""
    w = Window.partitionBy("user_id", "source_file", "date_posted", "value", F.substring("description", 1, 40)).orderBy("id")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def filled_forward(rows: DataFrame, value: str, by: list[str], order: str) -> DataFrame:
    """Carries the last seen section value down (statement sections, stacked sheets)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))
