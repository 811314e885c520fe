"""Sinks: exports, and writes that keep tables unique."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import predicates as P

ROW_KEY = ["user_id", "account", "date_posted", "amount", "description", "source_row"]


class MixedCurrencyError(ValueError):
    """An export that allows one currency got several."""


def single_currency(txns: DataFrame) -> str | None:
    found = [r.currency for r in txns.select("currency").distinct().orderBy("currency").limit(3).collect()]
    if len(found) > 1:
        raise MixedCurrencyError(f"one currency expected, found {', '.join(map(str, found))}")
    return found[0] if found else None


def _signed():
    return F.when(F.col("transaction_type") == "CREDIT", P.absolute()).otherwise(-P.absolute())


def ledger_csv(txns: DataFrame, proofs: DataFrame, taxonomy: DataFrame, linked: DataFrame) -> DataFrame:
    """Ledger rows by date: integer date, GIFI code and proof file. proofs: user_id, id, file; linked: user_id, id."""
    rows = txns.where(P.countable()).join(F.broadcast(taxonomy.select("category", "gifi")), "category", "left").join(proofs, ["user_id", "id"], "left")
    rows = P.with_flag(rows, linked, "is_linked")
    proof = F.coalesce(F.element_at(F.split("file", "/"), -1), F.when(F.col("is_linked"), F.lit("Linked (see Transfers sheet)")), F.lit(""))
    return rows.orderBy("date_posted", "id").select(F.regexp_replace("date_posted", "-", "").cast("int").alias("date"), "account", "transaction_type", _signed().alias("amount"), "currency", S.csv_safe("description").alias("description"), "category", "gifi", proof.alias("proof"))


def qbo_csv(txns: DataFrame) -> DataFrame:
    single_currency(txns)
    return txns.where(P.countable()).orderBy("date_posted", "id").select(F.date_format(F.to_date("date_posted"), "MM/dd/yyyy").alias("Date"), S.csv_safe("description").alias("Description"), S.money_text(_signed()).alias("Amount"))


def xero_csv(txns: DataFrame, codes: DataFrame) -> DataFrame:
    """codes: user_id, id, tax_code, tax_basis."""
    single_currency(txns)
    rows = txns.where(P.countable()).join(codes, ["user_id", "id"], "left")
    return rows.orderBy("date_posted", "id").select(F.date_format(F.to_date("date_posted"), "dd/MM/yyyy").alias("Date"), S.money_text(_signed()).alias("Amount"), S.csv_safe("description").alias("Description"), F.concat(F.lit("TXN-"), "id").alias("Reference"), F.coalesce("tax_code", F.lit("")).alias("TaxType"), F.coalesce("tax_basis", F.lit("")).alias("TaxBasis"))


def write_by_currency(export: DataFrame, path: str) -> None:
    """One folder for each currency."""
    export.write.mode("overwrite").partitionBy("currency").option("header", True).csv(path)


def transfers_sheet(links: DataFrame, txns: DataFrame) -> DataFrame:
    side = lambda tag: txns.select("user_id", F.col("id").alias(f"{tag}_transaction_id"), F.col("date_posted").alias(f"{tag}_date"), F.col("account").alias(f"{tag}_account"), _signed().alias(f"{tag}_amount"))
    return links.where(P.active()).select("user_id", "id", "link_type", "source_transaction_id", "target_transaction_id").join(side("source"), ["user_id", "source_transaction_id"], "left").join(side("target"), ["user_id", "target_transaction_id"], "left")


def sheet_name(account: str, month: str) -> str:
    return f"{account} {month}"[:31]


def audit_export(log: DataFrame, cap: int = 50_000) -> tuple[DataFrame, bool]:
    """The newest `cap` entries (the report's own limit) and whether some were cut."""
    out = log.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc()).limit(cap)
    return out, log.count() > cap


def insert_new(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows that are neither stored nor repeated in the batch, by the six-part key (nulls equal)."""
    fresh = rows.dropDuplicates(ROW_KEY)
    cond = [fresh[k].eqNullSafe(existing[k]) for k in ROW_KEY]
    return fresh.join(existing.select(*ROW_KEY), cond, "left_anti")


def insert_counts(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """How many rows of each batch file are new and how many are duplicates."""
    total = rows.groupBy("source_file").agg(F.count("*").alias("total"))
    new = insert_new(existing, rows).groupBy("source_file").agg(F.count("*").alias("inserted"))
    return total.join(new, "source_file", "left").fillna({"inserted": 0}).withColumn("duplicates", F.col("total") - F.col("inserted"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last())
    return old.unionByName(new).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def replace_file(txns: DataFrame, rows: DataFrame) -> DataFrame:
    """All rows of the files in `rows` are replaced by it."""
    return txns.join(rows.select("user_id", "source_file").distinct(), ["user_id", "source_file"], "left_anti").unionByName(rows)


def cascade_delete(links: DataFrame, matches: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and matches without those of deleted transactions (user_id, id)."""
    g = lambda name: gone.select("user_id", F.col("id").alias(name))
    kept = links.join(g("source_transaction_id"), ["user_id", "source_transaction_id"], "left_anti").join(g("target_transaction_id"), ["user_id", "target_transaction_id"], "left_anti")
    return kept, matches.join(g("transaction_id"), ["user_id", "transaction_id"], "left_anti")


def wipe(df: DataFrame, user_id) -> DataFrame:
    return df.where(F.col("user_id") != user_id)
