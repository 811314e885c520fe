"""Searching, paging and pools."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import predicates as P

SEARCH_COLUMNS = ["description", "account", "status", "category", "note", "source_file", "date_posted", "amount"]
DOCUMENT_COLUMNS = ["vendor", "original_filename", "currency", "document_date"]
SORTS = {"date": "date_posted", "amount": "amount", "description": "description", "status": "status", "account": "account"}
MAX_PAGE = 200


def grid(txns: DataFrame, *, account=None, status=None, month=None, source_file=None, category=None, start=None, end=None, least=None, most=None) -> DataFrame:
    out = txns
    for name, value in (("account", account), ("status", status), ("source_file", source_file)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if month:
        out = out.where(F.col("date_posted").startswith(month))
    if category is not None:
        out = out.where(F.col("category").isNull() if category == "Uncategorized" else F.col("category") == category)
    if start:
        out = out.where(F.col("date_posted") >= start)
    if end:
        out = out.where(F.col("date_posted") <= end)
    if least is not None:
        out = out.where(P.absolute() >= F.lit(least).cast(S.MONEY))
    if most is not None:
        out = out.where(P.absolute() <= F.lit(most).cast(S.MONEY))
    return out


def page(df: DataFrame, number: int, size: int, sort: str = "date", descending: bool = True) -> DataFrame:
    """One page in a total order (id breaks ties); amounts sort as numbers. The size is the feature's own limit."""
    size = min(max(size, 1), MAX_PAGE)
    key = S.money("amount") if sort == "amount" else F.col(SORTS[sort])
    order = [key.desc_nulls_last(), F.col("id").desc()] if descending else [key.asc_nulls_last(), F.col("id").asc()]
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_of_row(txns: DataFrame, size: int) -> DataFrame:
    """For every row its place by (date, id) within the tenant, its page, and the total.

    Places come from counts per day and places within the day, so no task sorts a whole tenant.
    """
    day = Window.partitionBy("user_id", "date_posted").orderBy("id")
    days = txns.groupBy("user_id", "date_posted").agg(F.count("*").alias("n"))
    before = Window.partitionBy("user_id").orderBy("date_posted").rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy("user_id")
    days = days.select("user_id", "date_posted", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"), F.sum("n").over(all_rows).alias("total"))
    out = txns.withColumn("k", F.row_number().over(day)).join(days, ["user_id", "date_posted"])
    place = F.col("earlier") + F.col("k")
    return out.select("user_id", "id", place.alias("place"), F.expr(f"(earlier + k - 1) div {size} + 1").alias("page"), "total")


def search_id(term: str) -> int | None:
    digits = term.strip().lstrip("#")
    return int(digits) if re.fullmatch("[0-9]{1,18}", digits) else None


def search_amount(term: str) -> str | None:
    bare = re.sub(r"[$,\s]", "", term).lstrip("+-")
    return bare if re.fullmatch(r"\d+(\.\d+)?", bare) else None


def regex_candidate(term: str) -> str | None:
    """A pattern only if it has a metacharacter, is of 200 characters at most and compiles."""
    if len(term) > 200 or not re.search(r"[\\^$.|?*+()\[\]{}]", term):
        return None
    try:
        re.compile(term)
    except re.error:
        return None
    return term


def transaction_search(term: str) -> Column:
    like = f"%{S.like_escaped(term.strip())}%"
    cols = [F.coalesce(F.col(c), F.lit("")) for c in SEARCH_COLUMNS]
    out = F.lit(False)
    for c in cols:
        out = out | c.ilike(like)
    if (pattern := regex_candidate(term.strip())) is not None:
        for c in cols:
            out = out | c.rlike("(?i)" + pattern)
    if (number := search_id(term)) is not None:
        out = out | (F.col("id") == number)
    if (amount := search_amount(term)) is not None:
        out = out | F.coalesce(P.absolute() == F.lit(amount).cast(S.MONEY), F.lit(False))
    return out


def one_edit_patterns(term: str, most: int = 24) -> list[str]:
    """LIKE patterns of one substitution, then one deletion, then one insertion; none for fewer than four letters."""
    t = term.strip().lower()
    if len(t) < 4:
        return []
    esc = [S.like_escaped(c) for c in t]
    made = ["".join([*esc[:i], "_", *esc[i + 1 :]]) for i in range(len(t))]
    made += ["".join([*esc[:i], *esc[i + 1 :]]) for i in range(len(t))]
    made += ["".join([*esc[:i], "_", *esc[i:]]) for i in range(1, len(t))]
    return list(dict.fromkeys(f"%{m}%" for m in made))[:most]


def document_search(term: str) -> Column:
    like = f"%{S.like_escaped(term.strip())}%"
    out = F.lit(False)
    for c in DOCUMENT_COLUMNS:
        out = out | F.coalesce(F.col(c), F.lit("")).ilike(like)
    for p in one_edit_patterns(term):
        out = out | F.lower(F.coalesce(F.col("vendor"), F.lit(""))).like(p) | F.lower(F.coalesce(F.col("original_filename"), F.lit(""))).like(p)
    if (number := search_id(term)) is not None:
        out = out | (F.col("id") == number)
    if (amount := search_amount(term)) is not None:
        out = out | F.coalesce(S.guarded_money("total") == F.lit(amount).cast(S.MONEY), F.lit(False))
    return out


def linkable(txns: DataFrame, links: DataFrame) -> DataFrame:
    return txns.where(F.col("status").isin("UNMATCHED", "IGNORED")).join(P.endpoints(links.where(P.active())), ["user_id", "id"], "left_anti")


def linked_ids(links: DataFrame) -> DataFrame:
    return P.endpoints(links.where(P.active()))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def unmatched_documents(receipts: DataFrame, matches: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Documents without an active match, one for each file hash; a dated bound leaves out undated ones."""
    used = matches.where(P.active()).select("user_id", F.col("document_id").alias("id")).distinct()
    out = receipts.join(used, ["user_id", "id"], "left_anti")
    if start:
        out = out.where(F.col("document_date") >= start)
    if end:
        out = out.where(F.col("document_date") <= end)
    return distinct_on(out, ["user_id", "file_hash"], [F.col("id").asc()])


def top_recent(txns: DataFrame, n: int) -> DataFrame:
    """The n latest rows of each tenant (a top-k report)."""
    w = Window.partitionBy("user_id").orderBy(F.col("date_posted").desc(), F.col("id").desc())
    return txns.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
