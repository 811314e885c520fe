"""Marketplace order exports to transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def _get(*names: str) -> Column:
    return F.coalesce(*[S.nullif_blank(F.col("c")[n]) for n in names])


def order_lines(rows: DataFrame) -> DataFrame:
    """Order lines of both export formats (rows: file, row, dialect, c): cancelled ones dropped, totals and taxes filled in."""
    num = lambda *n: F.abs(S.bracketed_money(_get(*n)))
    tax = F.coalesce(num("tax", "total tax", "unit price tax"), F.coalesce(num("federal tax"), F.lit(0)) + F.coalesce(num("provincial tax"), F.lit(0)) + F.coalesce(num("regulatory fee"), F.lit(0)))
    quantity = F.coalesce(_get("quantity", "item quantity", "original quantity").try_cast("int"), F.lit(1))
    total = F.coalesce(num("total owed", "total amount", "item net total"), (num("unit price", "purchase ppu", "item price") * quantity + tax).cast(S.MONEY))
    out = rows.where(F.col("dialect").startswith("market")).select(
        "file", "row", _get("order id").alias("order_id"), S.first_date(_get("ship date", "shipment date", "order date"), S.MARKET_FORMATS).alias("ship_date"), _get("product name", "title").alias("name"),
        F.coalesce(_get("currency", "currency code"), F.lit("CAD")).alias("currency"), total.cast(S.MONEY).alias("total"), tax.cast(S.MONEY).alias("tax"), F.lower(F.coalesce(_get("order status", "status"), F.lit(""))).alias("status"),
    )
    return out.where(~F.col("status").contains("cancel") & F.col("order_id").isNotNull() & F.col("total").isNotNull())


def shipments(lines: DataFrame, source_file: str = "orders") -> DataFrame:
    """One transaction for each (order, ship date): summed totals, first currency, joined names of up to 500 characters."""
    g = lines.groupBy("order_id", "ship_date").agg(F.sum("total").cast(S.MONEY).alias("total"), F.sum("tax").cast(S.MONEY).alias("tax"), F.min_by("currency", "row").alias("currency"), F.array_sort(F.collect_list(F.struct("row", "name"))).alias("names"), F.min("row").alias("source_row"))
    text = F.substring(F.array_join(F.transform("names", lambda x: x["name"]), "; "), 1, 500)
    return g.select(F.lit("DEBIT").alias("transaction_type"), F.date_format("ship_date", "yyyy-MM-dd").alias("date_posted"), F.col("total").cast("string").alias("amount"), "currency", text.alias("description"), "tax", "order_id", F.lit(source_file).alias("source_file"), F.col("source_row").cast("long").alias("source_row"))


def preview(lines: DataFrame) -> DataFrame:
    return lines.agg(F.countDistinct("order_id").alias("orders"), F.min("ship_date").alias("first_date"), F.max("ship_date").alias("last_date"))
