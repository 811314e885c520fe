"""Row predicates that nearly every query needs, and the lookups behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X


def tenant(df: DataFrame, user_id) -> DataFrame:
    """Every table is read for one tenant."""
    return df.where(F.col("user_id") == user_id)


def countable(status: str = "status") -> Column:
    return ~F.col(status).isin(X.NOT_COUNTABLE)


def active(status: str = "status") -> Column:
    return F.col(status) != X.ACTIVE_REJECT


def proves(status: str = "status") -> Column:
    return F.col(status).isin(X.PROOF_STATUSES)


def shown(status: str = "status") -> Column:
    return F.col(status).isin(X.DISPLAY_STATUSES)


def transfer_category(category: str = "category") -> Column:
    return S.normal(category).isin(X.TRANSFER_CATEGORY_KEYS)


def taxonomy(spark: SparkSession) -> DataFrame:
    """The 27 categories; broadcast freely."""
    names = "category string, kind string, section string, bucket string, gifi string, journal_only boolean, operating_revenue boolean, scrutiny double, generic boolean"
    return spark.createDataFrame(X.TAXONOMY, names)


def endpoints(links: DataFrame) -> DataFrame:
    """Distinct (user_id, id) at either end: OR-ed keys become one key, so joins stay equi-joins."""
    return links.select("user_id", F.explode(F.array("source_transaction_id", "target_transaction_id")).alias("id")).distinct()


def transfer_linked(links: DataFrame) -> DataFrame:
    return endpoints(links.where(active() & F.col("link_type").isin(X.TRANSFER_LINK_TYPES)))


def with_transfer(txns: DataFrame, links: DataFrame) -> DataFrame:
    """Adds is_transfer: transfer category by name, by taxonomy kind, or an active transfer-typed link at either end."""
    kinds = [c for c, kind, *_ in X.TAXONOMY if kind == "transfer"]
    linked = transfer_linked(links).withColumn("_by_link", F.lit(True))
    out = txns.join(linked, ["user_id", "id"], "left")
    flag = transfer_category() | F.coalesce(F.col("category").isin(kinds), F.lit(False)) | F.coalesce("_by_link", F.lit(False))
    return out.withColumn("is_transfer", flag).drop("_by_link")


def with_flag(txns: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """Adds whether (user_id, id) is among ids (distinct)."""
    return txns.join(ids.withColumn(name, F.lit(True)), ["user_id", "id"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def absolute(amount: str = "amount") -> Column:
    return F.abs(S.money(amount))


def is_expense(kind: str = "transaction_type", account: str = "account", amount: str = "amount") -> Column:
    """Direction from the type; by sign only where a row has no type (positive is an expense on a card alone)."""
    up, value = F.upper(F.coalesce(F.col(kind), F.lit(""))), S.money(amount)
    card = F.upper(F.col(account)).isin("CREDITCARD", "CREDIT_CARD")
    return F.when(up == "DEBIT", True).when(up == "CREDIT", False).when(card, value > 0).otherwise(value < 0)


def is_income_document(own_names: list[str], vendor: str = "vendor", filename: str = "original_filename", invoice: str = "invoice_number") -> Column:
    own = S.any_match(F.lower(F.col(vendor)), own_names) if own_names else F.lit(False)
    return own & (F.lower(F.coalesce(F.col(filename), F.lit(""))).contains("invoice") | F.coalesce(F.col(invoice) != "", F.lit(False)))


def sign_compatible(expense: Column, income_document: Column) -> Column:
    return expense != income_document


def non_reconcilable(description: str = "description") -> Column:
    return S.any_match(description, [p for _, settled, ps in X.CATEGORY_RULES if settled for p in ps])


def rule_category(description: str = "description") -> Column:
    return S.first_match(description, [(ps, c) for c, _, ps in X.CATEGORY_RULES])


def summary_line(description: str = "description") -> Column:
    """Balance and total lines of a statement: the whole text is such a phrase, in any case."""
    return F.coalesce(F.trim(F.col(description)).rlike("(?i)^(" + "|".join(X.SUMMARY_LINES) + ")$"), F.lit(False))


def priority_category(rules: list[tuple[str, str, int]], description: str = "description", vendor: str = "vendor") -> Column:
    """struct(category, source) of the first (pattern, category, priority) rule, highest priority first, that occurs in the description or the vendor; else Others."""
    out = F.lit(None).cast("string")
    for pattern, category, _ in reversed(sorted(rules, key=lambda r: -r[2])):  # among equal priorities the first stated wins
        out = F.when(S.any_match(description, [pattern]) | S.any_match(vendor, [pattern]), category).otherwise(out)
    return F.struct(F.coalesce(out, F.lit("Others")).alias("category"), F.when(out.isNull(), "default").otherwise("rule").alias("source"))
