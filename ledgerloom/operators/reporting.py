"""Reporting aggregates. Money is summed per currency only; transfers and uncounted rows stay out of income and expense."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X
from . import predicates as P

M = S.MONEY


def total(value: Column, when: Column | None = None) -> Column:
    """Decimal sum with 0 for no rows."""
    return F.coalesce(F.sum(F.when(when, value) if when is not None else value), F.lit(0)).cast(M)


def _money_rows(txns: DataFrame, links: DataFrame) -> DataFrame:
    return P.with_transfer(txns.where(P.countable()), links).where("not is_transfer").withColumn("value", P.absolute())


def flows(value: str = "value") -> list[Column]:
    income, expense = F.col("transaction_type") == "CREDIT", F.col("transaction_type") == "DEBIT"
    v = F.col(value)
    return [total(v, income).alias("income"), total(v, expense).alias("expenses"), (total(v, income) - total(v, expense)).cast(M).alias("net"), F.count("*").alias("n")]


def flows_of(value: Column) -> list[Column]:
    """income and expenses of rows, by type."""
    return [total(value, F.col("transaction_type") == "CREDIT").alias("income"), total(value, F.col("transaction_type") == "DEBIT").alias("expenses")]


def category_breakdown(txns: DataFrame, links: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    rows = txns
    if start:
        rows = rows.where(F.col("date_posted") >= start)
    if end:
        rows = rows.where(F.col("date_posted") <= end)
    return _money_rows(rows, links).groupBy("user_id", F.coalesce("category", F.lit(X.UNCATEGORIZED)).alias("category"), "currency").agg(*flows())


def monthly_trend(txns: DataFrame, links: DataFrame) -> DataFrame:
    return _money_rows(txns, links).groupBy("user_id", S.month("date_posted").alias("month"), "currency").agg(*flows())


def period_financials(txns: DataFrame, links: DataFrame, prefix: str) -> DataFrame:
    """Figures of the rows whose date starts with prefix, with the display rank: CAD, USD, then by activity and code."""
    out = _money_rows(txns.where(F.col("date_posted").startswith(prefix)), links).groupBy("user_id", "currency").agg(*flows())
    w = Window.partitionBy("user_id").orderBy(F.col("currency") != "CAD", F.col("currency") != "USD", (F.col("income") + F.col("expenses")).desc(), "currency")
    return out.withColumn("rank", F.row_number().over(w))


def current_previous_ytd(txns: DataFrame, links: DataFrame, month: str, previous: str) -> DataFrame:
    """Three periods in one pass."""
    rows = _money_rows(txns.where(F.col("date_posted") >= min(month[:4], previous[:4])), links)
    at, spans = S.month("date_posted"), {"current": None, "previous": None, "ytd": None}
    spans["current"], spans["previous"] = at == month, at == previous
    spans["ytd"] = (F.substring("date_posted", 1, 4) == month[:4]) & (at <= month)
    cols = [total(F.col("value"), cond & (F.col("transaction_type") == kind)).alias(f"{name}_{label}") for name, cond in spans.items() for kind, label in (("CREDIT", "income"), ("DEBIT", "expenses"))]
    return rows.groupBy("user_id", "currency").agg(*cols)


def status_flags(txns: DataFrame, matches: DataFrame, links: DataFrame) -> DataFrame:
    """Adds matched (an active match), linked (an active link) and resolved (either, or ignored)."""
    matched = matches.where(P.active()).select("user_id", F.col("transaction_id").alias("id")).distinct()
    out = P.with_flag(P.with_flag(txns, matched, "matched"), P.endpoints(links.where(P.active())), "linked")
    return out.withColumn("resolved", F.col("matched") | F.col("linked") | (F.col("status") == "IGNORED"))


def kpi_columns() -> list[Column]:
    n = F.count("*")
    return [
        n.alias("total"), F.count_if(F.col("status") == "IGNORED").alias("ignored"), F.count_if("resolved").alias("resolved"), F.count_if("matched").alias("matched"),
        F.count_if("linked").alias("linked"), F.when(n > 0, F.count_if("resolved").cast("double") / n).otherwise(0.0).alias("rate"),
    ]


def dashboard_kpi(txns: DataFrame, matches: DataFrame, links: DataFrame) -> DataFrame:
    return status_flags(txns.where(P.countable()), matches, links).groupBy("user_id").agg(*kpi_columns())


def monthly_status(txns: DataFrame, matches: DataFrame, links: DataFrame, year: int) -> DataFrame:
    """Twelve months for each tenant, months without rows included."""
    rows = status_flags(txns.where(P.countable() & F.col("date_posted").startswith(f"{year}-")), matches, links)
    got = rows.groupBy("user_id", F.substring("date_posted", 6, 2).cast("int").alias("month")).agg(*kpi_columns())
    grid = txns.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    zero = {c: 0 for c in ("total", "ignored", "resolved", "matched", "linked", "rate")}
    return grid.join(got, ["user_id", "month"], "left").fillna(zero)


def year_index(txns: DataFrame, matches: DataFrame, links: DataFrame) -> DataFrame:
    rows = P.with_transfer(status_flags(txns.where(P.countable()), matches, links), links).withColumn("value", P.absolute())
    own = ~F.col("is_transfer")
    return rows.groupBy("user_id", F.substring("date_posted", 1, 4).cast("int").alias("year")).agg(
        F.count("*").alias("n"), total(F.col("value"), own & (F.col("transaction_type") == "CREDIT") & (F.col("currency") == "CAD")).alias("income_cad"),
        total(F.col("value"), own & (F.col("transaction_type") == "DEBIT") & (F.col("currency") == "CAD")).alias("expenses_cad"),
        F.countDistinct(S.month("date_posted")).alias("months"), F.countDistinct("account").alias("accounts"), (F.count_if("resolved").cast("double") / F.count("*")).alias("rate"),
    )


def tax_summary(receipts: DataFrame) -> DataFrame:
    """Taxes by period: months, quarters and years by one rollup-like expansion; undated rows are a period of their own."""
    gst, hst = S.guarded_money(F.coalesce("tax_gst", F.lit(""))), S.guarded_money(F.coalesce("tax_hst", F.lit("")))
    year, month = F.substring("document_date", 1, 4), F.substring("document_date", 6, 2)
    quarter = F.concat(year, F.lit("-Q"), F.ceil(month.cast("int") / 3).cast("string"))
    periods = F.when(F.col("document_date").isNull(), F.array(F.lit("undated"))).otherwise(F.array(F.concat(year, F.lit("-"), month), quarter, year))
    rows = receipts.select("user_id", F.coalesce("currency", F.lit("CAD")).alias("currency"), F.explode(periods).alias("period"), gst.alias("gst"), hst.alias("hst"))
    return rows.groupBy("user_id", "period", "currency").agg(total(F.col("gst")).alias("gst"), total(F.col("hst")).alias("hst"), F.count_if(F.col("gst") + F.col("hst") != 0).alias("taxed"), F.count("*").alias("n"))


def doc_tax_by_transaction(matches: DataFrame, receipts: DataFrame) -> DataFrame:
    docs = receipts.select("user_id", F.col("id").alias("document_id"), S.guarded_money(F.coalesce("tax_gst", F.lit(""))).alias("g"), S.guarded_money(F.coalesce("tax_hst", F.lit(""))).alias("h"))
    return matches.where(P.proves()).join(docs, ["user_id", "document_id"]).groupBy("user_id", "transaction_id").agg(total(F.col("g")).alias("gst"), total(F.col("h")).alias("hst"), F.count("*").alias("documents"))


def category_pnl(txns: DataFrame, links: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Currency, section and category with subtotals: one rollup."""
    rows = _money_rows(txns, links).join(F.broadcast(taxonomy.select("category", "section")), "category", "left")
    rows = rows.withColumn("section", F.coalesce("section", F.lit("other"))).withColumn("category", F.coalesce("category", F.lit(X.UNCATEGORIZED)))
    signed = F.when(F.col("transaction_type") == "CREDIT", F.col("value")).otherwise(-F.col("value"))
    out = rows.groupBy("user_id", "currency", "section", "category").agg(total(signed).alias("net"), F.count("*").alias("n"))
    return out.rollup("user_id", "currency", "section", "category").agg(F.sum("net").cast(M).alias("net"), F.sum("n").cast("long").alias("n"), F.grouping_id().cast("int").alias("level")).where("user_id is not null and currency is not null")


def share_and_previous(txns: DataFrame, links: DataFrame, taxonomy: DataFrame, month: str, previous: str) -> DataFrame:
    """Categories of a month with their share of the section and the previous month's net."""
    def of(prefix):
        return category_breakdown(txns.where(F.col("date_posted").startswith(prefix)), links).select("user_id", "category", "currency", "net")

    now = of(month).join(F.broadcast(taxonomy.select("category", "section")), "category", "left").withColumn("section", F.coalesce("section", F.lit("other")))
    w = Window.partitionBy("user_id", "currency", "section")
    size = F.sum(F.abs("net")).over(w)
    now = now.withColumn("share", F.when(size > 0, (F.abs("net") / size).cast("double")).otherwise(0.0))
    return now.join(of(previous).withColumnRenamed("net", "previous_net"), ["user_id", "category", "currency"], "left").withColumn("change", (F.col("net") - F.col("previous_net")).cast(M))


def in_base_currency(totals: DataFrame, rates: DataFrame) -> DataFrame:
    """Sum in the base currency if every rate is known, else null. rates: currency, rate."""
    rows = totals.join(F.broadcast(rates), "currency", "left")
    known = F.count("rate") == F.count("*")
    return rows.groupBy("user_id").agg(F.when(known, F.sum((F.col("net") * F.col("rate")).cast("decimal(24,6)"))).cast(M).alias("net_base"), F.count("*").alias("currencies"))


def account_month(txns: DataFrame, links: DataFrame, month: str) -> DataFrame:
    """Account sections of a month with the preferred account order."""
    rows = P.with_transfer(txns.where(P.countable() & F.col("date_posted").startswith(month)), links).withColumn("value", P.absolute())
    order = F.array_position(F.array(*map(F.lit, X.ACCOUNT_ORDER)), F.col("account"))
    own = ~F.col("is_transfer")
    out = rows.groupBy("user_id", "account", "currency").agg(
        F.count("*").alias("n"), total(F.col("value"), own & (F.col("transaction_type") == "CREDIT")).alias("money_in"), total(F.col("value"), own & (F.col("transaction_type") == "DEBIT")).alias("money_out"),
        F.count_if("is_transfer").alias("transfers"),
    )
    w = Window.partitionBy("user_id").orderBy(F.when(order > 0, order).otherwise(1000), "account", "currency")
    return out.withColumn("place", F.row_number().over(w))


def dense_counts(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Counts of each listed value for every tenant, zero where there is none."""
    grid = df.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, values))).alias(column))
    return grid.join(df.groupBy("user_id", column).agg(F.count("*").alias("n")), ["user_id", column], "left").fillna({"n": 0})


def binder_tally(txns: DataFrame, matches: DataFrame, receipts: DataFrame, links: DataFrame) -> DataFrame:
    """Rows in exclusive buckets, in order: proof file, approved match without file, link, ignored, note, nothing."""
    files = receipts.where(F.col("original_filename").isNotNull()).select("user_id", F.col("id").alias("document_id"), F.lit(True).alias("has_file"))
    proof = matches.where(P.proves()).join(files, ["user_id", "document_id"], "left").groupBy("user_id", F.col("transaction_id").alias("id")).agg(F.bool_or(F.coalesce("has_file", F.lit(False))).alias("file"))
    rows = txns.where(P.countable()).join(proof, ["user_id", "id"], "left")
    rows = P.with_flag(rows, P.endpoints(links.where(P.active())), "linked")
    bucket = F.when(F.col("file"), "proof_file").when(F.col("file").isNotNull(), "match_without_file").when(F.col("linked"), "linked").when(F.col("status") == "IGNORED", "ignored").when(F.col("note").isNotNull(), "note").otherwise("missing")
    return rows.groupBy("user_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def net_income_by_sheet(txns: DataFrame) -> DataFrame:
    """Ledger sheets (account and month) by currency; here transfers are told by category alone."""
    rows = txns.where(P.countable() & ~P.transfer_category()).withColumn("value", P.absolute())
    return rows.groupBy("user_id", F.concat_ws(" ", "account", S.month("date_posted")).alias("sheet"), "currency").agg(*flows())


def bucket_rollup(txns: DataFrame, links: DataFrame, taxonomy: DataFrame, rates: DataFrame) -> DataFrame:
    """Spend per benchmark bucket in the base currency: sum, largest scrutiny weight and the category that weighs most."""
    rows = _money_rows(txns.where("category is not null and transaction_type = 'DEBIT'"), links).join(F.broadcast(taxonomy.select("category", "bucket", "scrutiny")), "category").join(F.broadcast(rates), "currency")
    per = rows.groupBy("user_id", "bucket", "category").agg(F.sum((F.col("value") * F.col("rate")).cast("decimal(24,6)")).alias("v"), F.max("scrutiny").alias("scrutiny"))
    return per.groupBy("user_id", "bucket").agg(F.sum("v").cast(M).alias("amount"), F.max("scrutiny").alias("scrutiny"), F.max_by("category", F.struct("v", "category")).alias("primary_category"))


def distinct_unmapped(txns: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return txns.where("category is not null").join(F.broadcast(taxonomy.select("category")), "category", "left_anti").select("user_id", "category").distinct()


def heaviest_file(txns: DataFrame, account: str, start: str, end: str) -> DataFrame:
    rows = txns.where((F.col("account") == account) & F.col("date_posted").between(start, end)).groupBy("user_id", "source_file").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("n").desc(), "source_file")
    return rows.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def checklist(txns: DataFrame, receipts: DataFrame, matches: DataFrame, links: DataFrame) -> DataFrame:
    """Counts and existence of each kind of record for every tenant, in one row."""
    parts = [df.groupBy("user_id").agg(F.count("*").alias(name)) for name, df in (("transactions", txns), ("receipts", receipts), ("matches", matches.where(P.proves())), ("links", links.where(P.active())))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "user_id", "left")
    out = out.fillna(0)
    names = ["transactions", "receipts", "matches", "links"]
    done = sum((F.col(n) > 0).cast("int") for n in names)
    return out.select("user_id", *names, *[(F.col(n) > 0).alias(f"has_{n}") for n in names], (done * 100.0 / len(names)).cast("double").alias("percent"))
