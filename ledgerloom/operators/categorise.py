"""Rules, vendor clusters and benchmark comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X
from . import predicates as P


def rule_categories(txns: DataFrame) -> DataFrame:
    return txns.select("user_id", "id", F.coalesce(P.rule_category(), F.lit(X.UNCATEGORIZED)).alias("category"), P.non_reconcilable().alias("settled"))


def vendor_clusters(txns: DataFrame) -> DataFrame:
    """Clusters by vendor key: count, total by currency, dates, first samples and notes. Rows are folded by text first, so keys are made once for each text and a hot vendor stays small."""
    texts = txns.withColumn("value", P.absolute()).groupBy("user_id", "description", "currency").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("date_posted").alias("first_date"), F.max("date_posted").alias("last_date"))
    per = texts.withColumn("vendor_key", S.vendor_key("description")).groupBy("user_id", "vendor_key", "currency").agg(
        F.sum("n").alias("n"), F.sum("total").cast(S.MONEY).alias("total"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.array_sort(F.collect_set("description")).alias("samples"),
    )
    return per.groupBy("user_id", "vendor_key").agg(
        F.sum("n").cast("long").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("currency", "total"))), lambda x: F.concat_ws("=", x.currency, x.total.cast("string"))), ";").alias("totals"),
        F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"), F.array_join(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("samples")))), 1, 5), ";").alias("samples"),
    )


def bucket(category: Column) -> Column:
    """Benchmark bucket: exact name, then normalised name, then the first rule one of whose words it contains."""
    exact = {c: b for c, _, _, b, *_ in X.TAXONOMY if b}
    plain = {"".join(ch for ch in c.lower() if ch.isalnum() and ch.isascii()): b for c, b in exact.items()}
    table = lambda d: F.create_map(*[F.lit(v) for kv in d.items() for v in kv])
    norm = S.normal(category)
    rules = S.first_match(norm, [(words, b) for words, b, *_ in X.BUCKET_RULES])
    return F.coalesce(table(exact)[category], table(plain)[norm], rules, F.lit("other_operating"))


def note_signal(note: Column) -> Column:
    return F.when(S.any_match(note, ["refund", "reimburse", "charge ?back"]), "refund").when(S.any_match(note, ["not sure", "unsure", "unknown", r"\?$"]), "uncertain")


def category_updates(txns: DataFrame, decisions: DataFrame) -> DataFrame:
    """What is written: confirmed rows never change; a refund note beats a rule, a rule beats a vendor decision; names off the list become null. decisions: user_id, vendor_key, decided."""
    names = [c for c, *rest in X.TAXONOMY if not rest[4]]
    rows = txns.withColumn("vendor_key", S.vendor_key("description")).join(decisions, ["user_id", "vendor_key"], "left")
    picked = F.when(note_signal(F.col("note")) == "refund", F.lit("Refund/Credit")).otherwise(F.coalesce(P.rule_category(), F.when(note_signal(F.col("note")) == "uncertain", F.lit(None).cast("string")).otherwise(F.col("decided"))))
    source = F.when(note_signal(F.col("note")) == "refund", "note").when(P.rule_category().isNotNull(), "rule").when(picked.isNotNull(), "vendor").otherwise("none")
    return rows.select("user_id", "id", F.when(picked.isin(names), picked).alias("new_category"), source.alias("source"))


def tax_codes(txns: DataFrame, doc_tax: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Tax code and basis of each export row. doc_tax: user_id, transaction_id, gst, hst."""
    d = doc_tax.select("user_id", F.col("transaction_id").alias("id"), (F.col("gst") + F.col("hst") > 0).alias("shows"))
    rows = txns.join(F.broadcast(taxonomy.select("category", "kind")), "category", "left").join(d, ["user_id", "id"], "left")
    code = S.tax_code(F.col("category"), F.col("kind"), S.jurisdiction(F.col("description"), F.lit(None).cast("string")), F.coalesce("shows", F.lit(False)), F.col("shows").isNotNull())
    return rows.select("user_id", "id", code.getField("code").alias("tax_code"), code.getField("basis").alias("tax_basis"))


# benchmark cube: rows (naics, band, cohort, bucket, pct, q1, median, q3, businesses)


def revenue_band(revenue: Column) -> Column:
    return F.when(revenue < 30_000, "under_30k").when(revenue < 100_000, "30k_100k").when(revenue < 500_000, "100k_500k").when(revenue < 2_000_000, "500k_2m").when(revenue < 5_000_000, "2m_5m").otherwise("over_5m")


def pick_cell(wanted: DataFrame, cube: DataFrame, least: int = 20) -> DataFrame:
    """The finest cell with enough businesses for each (user_id, naics, band): longest NAICS prefix, own band before 'all'."""
    prefixes = F.transform(F.sequence(F.length("naics"), F.lit(2), F.lit(-1)), lambda n: F.substr(F.col("naics"), F.lit(1), n))
    want = wanted.select("user_id", "band", F.posexplode(prefixes).alias("coarser", "naics"))
    cell = F.broadcast(cube.where(F.col("businesses") >= least).withColumnRenamed("band", "cell_band"))
    out = want.join(cell, "naics").where((F.col("cell_band") == F.col("band")) | (F.col("cell_band") == "all"))
    w = Window.partitionBy("user_id", "bucket").orderBy("coarser", F.col("cell_band") == "all", "cohort")
    return out.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def compare_ratio(ratio: Column, q1: Column, median: Column, q3: Column) -> Column:
    """Where a ratio stands: against the quartiles if they are in order, else 15% around the median."""
    ordered = (q1 <= median) & (median <= q3) & (q3 > q1)
    reach = q3 - q1
    quart = F.when(ratio > q3 + 1.5 * reach, "far_above").when(ratio > q3, "above").when(ratio < q1 - 1.5 * reach, "far_below").when(ratio < q1, "below").otherwise("within")
    mean = F.when(ratio > median * 1.15, "above").when(ratio < median * 0.85, "below").otherwise("within")
    return F.when(ordered, quart).when(median.isNotNull(), mean).otherwise("no_data")


def peer_lines(amounts: DataFrame, revenue: DataFrame, cells: DataFrame) -> DataFrame:
    """Each bucket's share of revenue against its cell, with a weight; the five heaviest flags of a tenant get a rank."""
    rows = amounts.join(revenue, "user_id").where("revenue > 0").withColumn("ratio", (F.col("amount") / F.col("revenue")).cast("double"))
    rows = rows.join(cells.select("user_id", "bucket", "q1", "median", "q3"), ["user_id", "bucket"], "left")
    rows = rows.withColumn("status", compare_ratio(F.col("ratio"), F.col("q1"), F.col("median"), F.col("q3")))
    weight = F.when(F.col("status").isin("far_above", "far_below"), 2.0).when(F.col("status").isin("above", "below"), 1.0).otherwise(0.0) * F.col("scrutiny")
    w = Window.partitionBy("user_id").orderBy(F.col("weight").desc(), "bucket")
    return rows.withColumn("weight", weight).withColumn("rank", F.row_number().over(w))


def peer_verdict(lines: DataFrame) -> DataFrame:
    n, heavy = F.count_if(F.col("weight") > 0), F.coalesce(F.sum("weight"), F.lit(0.0))
    return lines.groupBy("user_id").agg(n.alias("flags"), heavy.alias("weight"), F.when(n == 0, "in_line").when(heavy < 3, "minor").when(heavy < 8, "review").otherwise("strong").alias("verdict"))


def pattern_flags(amounts: DataFrame, revenue: DataFrame) -> DataFrame:
    """Patterns across buckets: contractors far over wages, expenses over revenue, travel and meals over a tenth of revenue."""
    wide = amounts.groupBy("user_id").pivot("bucket", ["subcontracts", "salaries_wages", "travel", "meals_entertainment"]).agg(F.sum("amount")).fillna(0)
    spent = amounts.groupBy("user_id").agg(F.sum("amount").alias("spent"))
    rows = wide.join(spent, "user_id").join(revenue, "user_id")
    flags = F.array_compact(F.array(
        F.when((F.col("subcontracts") > 0) & (F.col("subcontracts") > 3 * F.col("salaries_wages")), F.lit("contractor_skew")),
        F.when(F.col("spent") > F.col("revenue"), F.lit("expenses_over_revenue")),
        F.when((F.col("travel") + F.col("meals_entertainment")) * 10 > F.col("revenue"), F.lit("travel_meals_high")),
    ))
    return rows.select("user_id", F.explode(flags).alias("flag"))


def honest_band(average: Column, values: Column) -> Column:
    """struct(q1, median, q3) from cohort values if there are three, in order and around the mean; else the mean alone."""
    v = F.filter(values, lambda x: x.isNotNull())
    ordered = (F.array_sort(v) == v) | (F.reverse(F.array_sort(v)) == v)
    good = (F.size(v) >= 3) & ordered & average.between(F.array_min(v), F.array_max(v))
    none = F.lit(None).cast("double")
    return F.struct(F.when(good, F.array_min(v)).otherwise(none).alias("q1"), average.alias("median"), F.when(good, F.array_max(v)).otherwise(none).alias("q3"))


def inferred_naics(spend: DataFrame) -> DataFrame:
    """Industry code by what a tenant spends on, where a seeded industry clearly fits. spend: user_id, bucket, amount."""
    costs = spend.where(~F.col("bucket").isin("operating_revenue", "distribution", "transfer", "non_operating"))
    of = lambda b: F.sum(F.when(F.col("bucket") == b, F.col("amount").cast("double")).otherwise(0.0))
    shares = costs.groupBy("user_id").agg(F.sum(F.col("amount").cast("double")).alias("total"), of("cost_of_sales").alias("goods"), of("subcontracts").alias("sub"), of("it_software").alias("it"), of("rent").alias("rent")).where("total > 0")
    part = lambda c: F.col(c) / F.col("total")
    code = (
        F.when((part("goods") > 0.30) & (part("rent") > 0.03), "7225").when((part("goods") > 0.25) & (part("sub") > 0.15), "2361")
        .when((part("goods") < 0.15) & ((part("it") > 0.04) | (part("sub") > 0.15)), "5415")
    )
    return shares.select("user_id", code.alias("inferred")).where("inferred is not null")


def resolved_naics(profiles: DataFrame, spend: DataFrame) -> DataFrame:
    """Industry code and where it is from: the profile's code, its industry label, or the spending. profiles: user_id, naics_code, industry_label."""
    mapped = F.create_map(*[F.lit(x) for pair in X.INDUSTRY_CODES.items() for x in pair])[F.trim("industry_label")]
    stored = S.nullif_blank("naics_code")
    rows = profiles.join(inferred_naics(spend), "user_id", "left")
    source = F.when(stored.isNotNull(), "profile").when(mapped.isNotNull(), "industry_map").when(F.col("inferred").isNotNull(), "data_inferred")
    return rows.select("user_id", F.coalesce(stored, mapped, "inferred").alias("naics"), source.alias("naics_source"))


def profitability_lines(amounts: DataFrame, revenue: DataFrame, cells: DataFrame, least_share: float = 0.02, least_amount: float = 500.0) -> DataFrame:
    """Each bucket's share of revenue beside that of the most profitable quarter, largest first; small lines and lines without a figure are left out. cells: user_id, bucket, pct, businesses."""
    rows = amounts.join(revenue, "user_id").where("revenue > 0").withColumn("your_pct", (F.col("amount") / F.col("revenue")).cast("double"))
    rows = rows.where((F.col("your_pct") >= least_share) | (F.col("amount") >= least_amount)).join(cells.select("user_id", "bucket", F.col("pct").alias("peer_pct"), "businesses"), ["user_id", "bucket"]).where("peer_pct is not null")
    w = Window.partitionBy("user_id").orderBy(F.col("your_pct").desc(), "bucket")
    return rows.withColumn("rank", F.row_number().over(w)).select("user_id", "bucket", "your_pct", "peer_pct", "businesses", "rank")


def cached_decisions(clusters: DataFrame, cache: DataFrame) -> DataFrame:
    """(user_id, vendor_key, category, reused) of vendor clusters (user_id, vendor_key, proof_coverage): a decision of an earlier
    run (cache: user_id, vendor_key, category) is used again only if no row of the cluster has proof and its category is
    still one that may be assigned; otherwise the category is null and the vendor is to be judged anew."""
    names = [name for name, *_ in X.TAXONOMY]
    one = cache.groupBy("user_id", "vendor_key").agg(F.min("category").alias("cached"))
    out = clusters.join(one, ["user_id", "vendor_key"], "left")
    use = F.coalesce(F.col("cached").isin(names) & (F.col("proof_coverage") <= 0), F.lit(False))
    return out.select("user_id", "vendor_key", F.when(use, F.col("cached")).alias("category"), use.alias("reused"))


def cluster_keys(rows: DataFrame) -> DataFrame:
    """(user_id, id, vendor_key, key_source) of rows (user_id, id, description, proof_vendor, stored_key, model_key).

    The vendor of an approved proof is the merchant; else the description decides, anew on each run. Only where it names
    nobody do a stored key and a model's key count, and at last the first word of the description.
    """
    slug = F.substring(F.split_part(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("description", F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit("_"), F.lit(1)), 1, 32)
    key = lambda c: F.nullif(c, F.lit(""))
    levels = [("proof", key(S.vendor_key("proof_vendor"))), ("description", key(S.vendor_key("description"))), ("stored", key(F.col("stored_key"))), ("model", key(F.lower(F.trim("model_key")))), ("slug", key(slug))]
    found = F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("k"), F.lit(name).alias("s"))) for name, c in levels], F.struct(F.lit("unknown").alias("k"), F.lit("none").alias("s")))
    return rows.withColumn("_f", found).select("user_id", "id", F.col("_f.k").alias("vendor_key"), F.col("_f.s").alias("key_source"))
