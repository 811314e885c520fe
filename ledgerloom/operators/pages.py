"""Answers read from a document's page batches, merged into one record.

Every rule is a minimum or maximum over the batches (the first that reports a field, the last that claims the total), so
tasks combine before the shuffle and the order of arrival doesn't matter; only line items and claims, which belong to
the record, are gathered, by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X

AGREE = "0.02"  # claims of the total this near are one figure read twice


def blank(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("", "null", "none", "n/a"), F.lit(True))


def figure(c: Column) -> Column:
    """Amount of an extracted figure: currency signs, commas and a trailing code go; what can't be read is 0."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), "[$, ]", ""), "[A-Za-z]+$", ""))
    return F.coalesce(F.nullif(bare, F.lit("")).try_cast(S.MONEY), F.lit(0).cast(S.MONEY))


def claimed_page(r: Column) -> Column:
    """Page on which an answer sees the grand total; 0 where it only says that it does; null where it makes no claim."""
    pages = [F.when(r[k].rlike(r"^\s*\+?\d+\s*$"), F.trim(r[k]).try_cast("int")) for k in ("grand_total_page", "grand_total_on_page", "total_page")]
    named = F.coalesce(*[F.when(p > 0, p) for p in pages])
    yes = S.any_of([F.coalesce(F.lower(F.trim(r[k])).isin("true", "yes"), F.lit(False)) for k in ("has_grand_total", "shows_grand_total")])
    return F.coalesce(named, F.when(yes, 0))


def batches(answers: DataFrame) -> DataFrame:
    """answers (user_id, document_id, batch, last_page, json) with the answer as a map; nested values stay JSON text."""
    return answers.select("user_id", "document_id", "batch", "last_page", F.from_json("json", "map<string,string>").alias("r"))


def merged(parts: DataFrame, pages_total: str | None = None, pages_used: str | None = None) -> DataFrame:
    """One record for each document; parts: user_id, document_id, batch, last_page, r (map of texts).

    Identity fields come from the first batch that reports them, batches that continue a table last; a vendor that says
    the pages are no financial document counts only if there is no other. The total is the claim of the latest page (then
    batch); without a claim the last batch with a figure. Taxes come from the total's batch, else from the first that
    has any. Line items follow one another by batch. `reasons` says what a person should look at: claims that differ by
    more than two cents, no claim, no figure, pages left out, an answer of low confidence. A null answer reports nothing.
    pages_total and pages_used name columns of parts.
    """
    r, cont = F.col("r"), F.coalesce(F.lower(F.trim(F.col("r")["continuation"])).isin("true", "yes", "1"), F.lit(False))
    raw = F.when(blank(r["total"]), r["amount"]).otherwise(r["total"])
    rows = parts.withColumn("_cont", cont).withColumn("_raw", raw).withColumn("_fig", figure(raw)).withColumn("_claim", claimed_page(r))
    rows = rows.withColumn("_page", F.when(F.col("_fig") != 0, F.when(F.col("_claim") > 0, F.col("_claim")).when(F.col("_claim") == 0, F.col("last_page"))))
    claim = F.col("_page").isNotNull()
    siblings = F.struct(*[F.when(~blank(r[f]), r[f]).alias(f) for f in X.TOTAL_SIBLINGS])
    at_claim = F.struct(F.col("_page").alias("page"), F.col("batch").alias("batch"), F.col("_raw").alias("raw"), F.col("_fig").alias("amount"), siblings.alias("s"))
    first = lambda f, ok: F.min(F.when(ok, F.struct(F.col("_cont"), F.col("batch"), r[f].alias("v")))).getField("v")
    said = {f: ~blank(r[f]) & ((F.trim(r[f]) != X.NOT_FINANCIAL) if f == "vendor" else F.lit(True)) for f in X.IDENTITY_FIELDS}
    items = F.from_json(r["line_items"], "array<string>")
    whole = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.ltrim(x).startswith("{"))
    aggs = [first(f, ok).alias(f"_{f}") for f, ok in said.items()]
    aggs += [F.min(F.when(~blank(r[f]), F.struct("batch", r[f].alias("v")))).getField("v").alias(f"_any_{f}") for f in X.TOTAL_SIBLINGS]
    aggs += [
        F.bool_or(F.coalesce(F.trim(r["vendor"]) == X.NOT_FINANCIAL, F.lit(False))).alias("_none"), F.max(F.when(claim, at_claim)).alias("_last"), F.min(F.when(claim, at_claim)).getField("amount").alias("_first"),
        F.max(F.when(claim, F.col("_fig"))).alias("_high"), F.min(F.when(claim, F.col("_fig"))).alias("_low"), F.max(F.when(F.col("_fig") != 0, F.struct("batch", F.col("_raw").alias("raw"), siblings.alias("s")))).alias("_back"),
        F.array_sort(F.collect_list(F.when(claim, F.struct(F.col("_page").alias("page"), "batch", F.col("_fig").alias("amount"))))).alias("claims"),
        F.array_sort(F.collect_list(F.when(F.size(whole) > 0, F.struct("batch", whole.alias("x"))))).alias("_items"), F.count("*").alias("n_batches"), F.bool_or(F.coalesce(r["_confidence"] == "low", F.lit(False))).alias("_weak"),
        *([F.max(pages_total).alias("pages_total"), F.max(pages_used).alias("pages_used")] if pages_total and pages_used else [F.lit(None).cast("int").alias("pages_total"), F.lit(None).cast("int").alias("pages_used")]),
    ]
    one = rows.groupBy("user_id", "document_id").agg(*aggs)
    near = F.lit(AGREE).cast("decimal(4,2)")
    disagree = F.coalesce((F.col("_high") - F.col("_first") > near) | (F.col("_first") - F.col("_low") > near), F.lit(False))
    none, total = F.col("_last").isNull() & F.col("_back").isNull(), F.coalesce("_last.raw", "_back.raw")
    reasons = F.array_compact(F.array(
        F.when(disagree, F.lit("totals_disagree")), F.when(none, F.lit("no_amount")).when(F.col("_last").isNull(), F.lit("no_grand_total")), F.when(F.col("pages_used") < F.col("pages_total"), F.lit("pages_left_out")), F.when(F.col("_weak"), F.lit("low_confidence")),
    ))
    vendor = F.coalesce("_vendor", F.when(F.col("_none"), X.NOT_FINANCIAL))
    identity = [vendor.alias("vendor"), *[F.col(f"_{f}").alias(f) for f in X.IDENTITY_FIELDS if f != "vendor"]]
    taxes = [F.coalesce(F.when(F.col("_last").isNotNull(), F.col(f"_last.s.{f}")).otherwise(F.col(f"_back.s.{f}")), F.col(f"_any_{f}")).alias(f) for f in X.TOTAL_SIBLINGS]
    return one.select("user_id", "document_id", *identity, total.alias("total"), *taxes, F.flatten(F.transform("_items", lambda x: x["x"])).alias("line_items"), "claims", "n_batches", "pages_total", "pages_used", F.array_join(reasons, ",").alias("reasons"))
