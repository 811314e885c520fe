"""Patterns across a tenant's buckets, and the verdict over all flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Thresholds as shares of revenue, the least material amount, weights, flags shown, and when several stand out
CONTRACTOR_SHARE, CONTRACTOR_LEAST, GENERIC_SHARE, LINE_SHARE = 0.60, 0.25, 0.50, 0.05
MATERIAL = 500.0
SHOWN, SEVERAL_STANDING_OUT, SEVERAL = 5, 2, 4
CONTRACTOR_BUCKETS = ["subcontracts", "professional_fees", "salaries_wages"]
LINES = [("travel", "pattern_travel_over_threshold"), ("meals_entertainment", "pattern_meals_over_threshold"), ("motor_vehicle", "pattern_vehicle_over_threshold")]
FLAG = ["user_id", "flag_key", "layer", "severity", "bucket", "amount", "your_pct", "weight"]


def facts(rows: DataFrame, taxonomy: DataFrame, rates: DataFrame) -> DataFrame:
    """What the patterns need of a tenant, from its categories (user_id, category, currency, income, expenses) in the base currency.

    Columns: user_id, revenue and generic (operating income, and what of it is in a generic category), drawn (equity
    categories, by magnitude), spent, fragmented (two material categories of one bucket), by_bucket and scrutiny (maps).
    Unknown categories count as other expenses, currencies without a rate not at all.
    """
    t = taxonomy.select("category", "kind", "bucket", "operating_revenue", "generic", "scrutiny")
    r = rows.join(F.broadcast(t), "category", "left").join(F.broadcast(rates), "currency").withColumn("bucket", F.coalesce("bucket", F.lit("other_operating")))
    r = r.where(~F.col("bucket").isin("transfer", "non_operating"))
    income, spent = (F.col(c) * F.col("rate") for c in ("income", "expenses"))
    equity, operating = F.coalesce(F.col("kind") == "equity", F.lit(False)), F.coalesce("operating_revenue", F.lit(False))
    d = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(24,6)").cast("double")
    r = r.select("user_id", "category", "bucket", F.coalesce("scrutiny", F.lit(1.0)).alias("scrutiny"), F.coalesce("generic", F.lit(False)).alias("generic"), equity.alias("equity"), (operating & ~equity).alias("operating"), d(income).alias("income"), d(spent).alias("spent"), d(income - spent).alias("net"))
    cost = ~F.col("equity") & ~F.col("operating") & (F.col("spent") > 0)
    when = lambda cond, c: F.when(cond, F.col(c)).otherwise(0.0)
    # a category is judged by currency, as it is listed
    material = F.when(F.col("operating"), F.col("income") >= MATERIAL).otherwise(cost & (F.col("spent") >= MATERIAL))
    per = r.groupBy("user_id", "bucket", "category").agg(F.sum(when(cost, "spent")).alias("spent"), F.sum(when(F.col("operating"), "income")).alias("revenue"), F.sum(when(F.col("operating") & F.col("generic"), "income")).alias("generic"), F.sum(F.when(F.col("equity"), F.abs("net")).otherwise(0.0)).alias("drawn"), F.max(F.when(cost, F.col("scrutiny"))).alias("scrutiny"), F.bool_or(material).alias("material"))
    by = per.groupBy("user_id", "bucket").agg(F.sum("spent").alias("spent"), F.sum("revenue").alias("revenue"), F.sum("generic").alias("generic"), F.sum("drawn").alias("drawn"), F.max("scrutiny").alias("scrutiny"), F.count_if("material").alias("sources"))
    entry = lambda v: F.map_from_entries(F.collect_list(F.when(F.col("spent") > 0, F.struct("bucket", v))))
    return by.groupBy("user_id").agg(F.sum("revenue").alias("revenue"), F.sum("generic").alias("generic"), F.sum("drawn").alias("drawn"), F.sum("spent").alias("spent"), F.bool_or(F.col("sources") >= 2).alias("fragmented"), entry("spent").alias("by_bucket"), entry("scrutiny").alias("scrutiny"))


def cents(value: Column) -> Column:
    """A sum of money rounded half up: binary noise goes first."""
    return F.round(value.cast("decimal(24,6)"), 2).cast("double")


def flags(tenants: DataFrame, ratio_flags: DataFrame) -> DataFrame:
    """All flags (FLAG) of tenants (facts) with revenue: the patterns, and ratio_flags (user_id, flag_key, severity, bucket, amount, your_pct, weight).

    Contractors far over payroll subsume the ratio flags of CONTRACTOR_BUCKETS; travel, meals and vehicles over a share of
    revenue are told only where no ratio flag is left on the bucket.
    """
    t = tenants.where("revenue > 0").join(ratio_flags.groupBy("user_id").agg(F.collect_set("bucket").alias("flagged")), "user_id", "left")
    amount = lambda b: F.coalesce(F.col("by_bucket")[b], F.lit(0.0))
    scrutiny = lambda b, other: F.greatest(F.coalesce(F.col("scrutiny")[b], F.lit(other)), F.lit(1.0))
    revenue, contractors = F.col("revenue"), amount("subcontracts") + amount("professional_fees")
    labour = amount("salaries_wages") + amount("employee_benefits")
    t = t.withColumn("skew", (labour + contractors > 0) & (contractors > CONTRACTOR_SHARE * (labour + contractors)) & (contractors / revenue > CONTRACTOR_LEAST))
    left = F.coalesce(F.when(F.col("skew"), F.array_except("flagged", F.array(*map(F.lit, CONTRACTOR_BUCKETS)))).otherwise(F.col("flagged")), F.array().cast("array<string>"))

    def flag(cond: Column, key: str, severity: str, bucket: str | None, value: Column | None, share: Column | None, weight: Column) -> Column:
        none = F.lit(None).cast("double")
        return F.when(cond, F.struct(F.lit(key).alias("flag_key"), F.lit("B").alias("layer"), F.lit(severity).alias("severity"), F.lit(bucket).cast("string").alias("bucket"), (none if value is None else cents(value)).alias("amount"), (none if share is None else share).alias("your_pct"), weight.alias("weight")))

    found = [flag(F.col("skew"), "pattern_contractor_heavy", "elevated", "subcontracts", contractors, contractors / revenue, contractors / revenue * scrutiny("subcontracts", 1.5) * 10.0)]
    found.append(flag(F.col("generic") / revenue > GENERIC_SHARE, "pattern_generic_income_bucket", "elevated", "operating_revenue", F.col("generic"), F.col("generic") / revenue, F.col("generic") / revenue * 5.0))
    for bucket, key in LINES:
        share = amount(bucket) / revenue
        found.append(flag(~F.array_contains(left, bucket) & (share > LINE_SHARE), key, "elevated", bucket, amount(bucket), share, share * scrutiny(bucket, 2.0) * 10.0))
    found.append(flag(F.col("spent") > revenue, "pattern_expenses_exceed_revenue", "stands_out", None, F.col("spent"), None, F.lit(12.0)))
    found.append(flag(F.col("fragmented"), "pattern_category_fragmentation", "elevated", None, None, None, F.lit(3.0)))
    found.append(flag(F.col("drawn") > 0, "info_owners_draw_present", "info", "distribution", None, None, F.lit(0.0)))
    patterns = t.select("user_id", F.explode(F.array_compact(F.array(*found))).alias("f")).select("user_id", "f.*")
    ratios = ratio_flags.join(t.select("user_id", "skew"), "user_id").where(~(F.col("skew") & F.col("bucket").isin(CONTRACTOR_BUCKETS))).withColumn("layer", F.lit("A"))
    return patterns.select(FLAG).unionByName(ratios.select(FLAG))


def verdict(tenants: DataFrame, flagged: DataFrame, dismissed: DataFrame) -> DataFrame:
    """(user_id, band, shown, n_flags, n_dismissed): the heaviest SHOWN flags that weren't dismissed (user_id, flag_key), and the band they make.

    Infos count for no band: none is typical, two that stand out or four in all are several, else a few.
    """
    gone = dismissed.select("user_id", "flag_key", F.lit(True).alias("gone")).distinct()
    f = flagged.join(gone, ["user_id", "flag_key"], "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    w = Window.partitionBy("user_id", "gone").orderBy(F.desc("weight"), "flag_key")
    f = f.withColumn("k", F.row_number().over(w)).withColumn("top", ~F.col("gone") & (F.col("k") <= SHOWN))
    real = F.col("top") & (F.col("severity") != "info")
    by = f.groupBy("user_id").agg(F.count_if(~F.col("gone")).alias("n_flags"), F.count_if("gone").alias("n_dismissed"), F.count_if(real).alias("real"), F.count_if(real & (F.col("severity") == "stands_out")).alias("out"), F.array_sort(F.collect_list(F.when(F.col("top"), F.struct("k", "flag_key")))).alias("s"))
    band = F.when((F.col("out") >= SEVERAL_STANDING_OUT) | (F.col("real") >= SEVERAL), "several").when(F.col("real") > 0, "a_few").otherwise("typical")
    rows = tenants.where("revenue > 0").select("user_id").join(by, "user_id", "left").na.fill(0, ["n_flags", "n_dismissed", "real", "out"])
    return rows.select("user_id", band.alias("band"), F.coalesce(F.array_join(F.transform("s", lambda x: x["flag_key"]), ","), F.lit("")).alias("shown"), "n_flags", "n_dismissed")
