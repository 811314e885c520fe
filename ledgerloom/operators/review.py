"""Review aids: pair heuristics, validator fallbacks, ground-truth comparison, audit views, link decisions, benchmark cube."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X
from . import predicates as P

LINK_DAYS = 21
TRANSFER_PAIRS = sorted({f"{a}|{b}" for ps in X.VALID_ACCOUNT_PAIRS.values() for a, b in ps})
SUBSCRIPTION_WORDS = ["subscription", "subscript", "recurring", "monthly", "annual", "renewal", "plan", "licen", "saas", "software", "cloud", "hosting", "domain"]
RAIL_WORDS = ["wise", "paypal", "wire", "interac", "transfer"]
FOOD_WORDS = ["restaurant", "cafe", "bar", "food"]


def plausible(src: Column, tgt: Column, same: Column, gap: Column) -> Column:
    """Whether a pair is worth a model's time: within 21 days, amounts near (50 or 30%) or in the rate band."""
    larger, smaller = F.greatest(src, tgt), F.least(src, tgt)
    near = (larger - smaller <= 50) | (larger - smaller <= larger * F.lit("0.30").cast("decimal(4,2)"))
    return (gap <= LINK_DAYS) & (smaller > 0) & F.when(same, near).otherwise(larger <= smaller * F.lit(X.FX_MAX).cast("decimal(4,2)"))


def amount_ratio(src: Column, tgt: Column, same: Column) -> Column:
    return F.when(~same & (tgt != 0), F.bround((src / tgt).cast("decimal(18,8)"), 4).cast("double"))


def heuristic_score(src: Column, tgt: Column, same: Column, gap: Column, pair: Column) -> Column:
    """.50 amount closeness, .30 date closeness, .20 known account pair; rates count by their distance from the band's middle."""
    low, high = float(X.FX_MIN), float(X.FX_MAX)
    mid, half = (low + high) / 2, (high - low) / 2
    ratio = amount_ratio(src, tgt, same)
    inverse = 1 / ratio
    rate = F.when(ratio.between(low, high), ratio).when(inverse.between(low, high), inverse)
    cross = F.coalesce(F.greatest(1 - F.abs(rate - mid) / half * 0.5, F.lit(0.0)), F.lit(0.3))
    own = F.greatest(F.lit(0.0), 1 - (F.abs(src - tgt) / F.greatest(src, tgt, F.lit(1))).cast("double"))
    return 0.5 * F.when(same, own).otherwise(cross) + 0.3 * F.greatest(F.lit(0.0), 1 - gap / float(LINK_DAYS)) + 0.2 * F.when(pair.isin(TRANSFER_PAIRS), 1.0).otherwise(0.5)


def top_candidates(pairs: DataFrame, score: str = "score", most: int = 200) -> DataFrame:
    """The best pairs of each tenant for a model pass (the pass's own limit), in a total order."""
    w = Window.partitionBy("user_id").orderBy(F.col(score).desc(), "source_id", "target_id")
    return pairs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def acceptable_days(description: Column, vendor: Column, account: Column) -> Column:
    d, v = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(vendor, F.lit("")))
    has = lambda c, words: F.exists(F.array(*map(F.lit, words)), lambda w: c.contains(w))
    return F.when(has(d, SUBSCRIPTION_WORDS) | has(v, SUBSCRIPTION_WORDS), 45).when(has(d, RAIL_WORDS), 10).when(account == "CreditCard", 7).otherwise(14)


def acceptable_difference(description: Column, txn: Column, doc: Column, wire_fee: float = 25.0) -> Column:
    """Largest acceptable gap between same-currency amounts."""
    d = F.lower(F.coalesce(description, F.lit("")))
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: d.contains(w))
    t = F.abs(txn).cast("double")
    diff = F.abs(F.abs(txn) - F.abs(doc)).cast("double")
    return F.when(has(["wise", "wire", "transfer", "interac"]), wire_fee).when(has(FOOD_WORDS), t * 0.25).when(diff <= t * 0.15, t * 0.15).otherwise(2.0)


def field_confidence(payload: Column) -> Column:
    """Grades of a map payload's vendor, date, total and currency."""
    vendor, date, currency = F.trim(payload["vendor"]), F.trim(payload["date"]), S.currency_code(payload["currency"])
    total = S.bracketed_money(payload["total"])
    grades = {
        "vendor": F.when(F.coalesce(vendor, F.lit("")).isin("", "NOT_A_FINANCIAL_DOCUMENT"), "low").when(F.length(vendor) >= 2, "high").otherwise("medium"),
        "date": F.when(date.isNull(), "low").when(date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(date).isNotNull(), "high").otherwise("medium"),
        "total": F.when(total > 0, "high").otherwise("low"),
        "currency": F.when(currency.isNull(), "low").when(currency.isin("CAD", "USD", "CNY", "EUR", "GBP"), "high").otherwise("medium"),
    }
    return F.map_from_arrays(F.array(*map(F.lit, grades)), F.array(*grades.values()))


def needs_review(grades: Column) -> Column:
    return F.exists(F.map_values(grades), lambda g: g == "low")


# ground truth


def compare_to_truth(parsed: DataFrame, truth: DataFrame, days: int = 3) -> DataFrame:
    """(id, truth_id, stage): one-to-one pairs by account, date and amount, then the nearest date, then both across accounts.

    Both sides: id, account, date, amount (magnitude). Rows of one amount meet in one group, in date order.
    """
    rows = parsed.select("id", "account", "date", "amount", F.lit("parsed").alias("side")).unionByName(truth.select("id", "account", "date", "amount", F.lit("truth").alias("side")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["account", "date", "id"])
        mine = list(pdf[pdf.side == "parsed"].itertuples())
        out, used = [], set()
        left = list(pdf[pdf.side == "truth"].itertuples())
        for stage, (same_account, reach) in enumerate([(True, 0), (True, days), (False, 0), (False, days)], 1):
            rest = []
            for t in left:
                fits = [(abs((m.date - t.date).days), m.id) for m in mine if m.id not in used and (not same_account or m.account == t.account) and abs((m.date - t.date).days) <= reach]
                if fits:
                    used.add(min(fits)[1])
                    out.append((min(fits)[1], t.id, stage))
                else:
                    rest.append(t)
            left = rest
        return pd.DataFrame(out, columns=["id", "truth_id", "stage"])

    return rows.groupBy("amount").applyInPandas(run, "id long, truth_id long, stage int")


def match_report(parsed: DataFrame, truth: DataFrame, found: DataFrame) -> DataFrame:
    return truth.agg(F.count("*").alias("truth")).join(parsed.agg(F.count("*").alias("parsed"))).join(found.agg(F.count("*").alias("matched"))).withColumn("rate", F.try_divide(F.col("matched").cast("double"), F.col("truth")))


# audit, jobs, decisions


def audit_view(log: DataFrame, *, action=None, entity=None, start=None, end=None) -> DataFrame:
    """Audit rows, newest first; the end date is inclusive."""
    out = log
    if action:
        out = out.where(F.col("action") == action)
    if entity:
        out = out.where(F.col("entity_type") == entity)
    if start:
        out = out.where(F.col("created_at") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("created_at") < F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    return out.orderBy(F.col("created_at").desc_nulls_last(), F.col("id").desc())


def bulk_approve(matches: DataFrame, requested: float) -> DataFrame:
    """Pending matches from the larger of .85 and the requested score are approved; the others are left."""
    gate = (F.col("status") == "PENDING_REVIEW") & (F.col("confidence_score") >= F.greatest(F.lit(0.85), F.lit(requested)))
    return matches.withColumn("status", F.when(gate, "USER_APPROVED").otherwise(F.col("status")))


def orphaned_statements(statements: DataFrame, jobs: DataFrame) -> DataFrame:
    """Processing statements that no open job's JSON result names."""
    held = jobs.where(F.col("status").isin("pending", "running", "waiting")).select("user_id", F.get_json_object("result", "$.statement_id").cast("long").alias("id")).where("id is not null")
    return statements.where("status = 'PROCESSING'").join(held, ["user_id", "id"], "left_anti")


def reject_links(links: DataFrame, chosen: DataFrame, chains: DataFrame | None = None) -> DataFrame:
    """Links with the chosen ones rejected, and their whole chains if chains (user_id, link_id, chain_id) are given. Rows stay: they are the memory of the rejection."""
    ids = chosen.select("user_id", F.col("id").alias("link_id"))
    if chains is not None:
        hit = chains.join(ids, ["user_id", "link_id"]).select("user_id", "chain_id").distinct()
        ids = ids.unionByName(chains.join(hit, ["user_id", "chain_id"]).select("user_id", "link_id"))
    flag = ids.distinct().withColumnRenamed("link_id", "id")
    return P.with_flag(links, flag, "_gone").withColumn("status", F.when(F.col("_gone"), X.ACTIVE_REJECT).otherwise(F.col("status"))).drop("_gone")


def link_group(user_id: int, anchor: int, legs: list[int], link_type: str, spark) -> DataFrame:
    """Links of one anchor to ordered legs; an anchor among its legs or a leg named twice is an error."""
    if anchor in legs or len(set(legs)) != len(legs) or not legs:
        raise ValueError("a group needs distinct legs other than its anchor")
    rows = [(user_id, anchor, leg, link_type, k, "USER_APPROVED") for k, leg in enumerate(legs)]
    return spark.createDataFrame(rows, "user_id long, source_transaction_id long, target_transaction_id long, link_type string, chain_position int, status string")


def shared_report(reports: DataFrame, token: str, now: str) -> DataFrame:
    return reports.where((F.col("token") == token) & (F.col("expires_at") > F.lit(now).cast("timestamp")))


# benchmark cube


def preferred_rows(rows: DataFrame, preference: list[int]) -> DataFrame:
    """One row for each (naics, geo): the first incorporation status in the order of preference."""
    rank = F.array_position(F.array(*map(F.lit, preference)), F.col("incorporation"))
    w = Window.partitionBy("naics", "geo").orderBy(F.when(rank > 0, rank).otherwise(999), "incorporation")
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def cube(expenses: DataFrame, revenue: DataFrame, profit: DataFrame, margin: DataFrame) -> DataFrame:
    """Expense rows joined to revenue, profit and margin on (naics, geo); suppressed figures are null and quartile counts a quarter each."""
    keys = ["naics", "geo"]
    out = expenses.join(revenue, keys, "left").join(profit, keys, "left").join(margin, keys, "left")
    return out.withColumn("quartile_businesses", F.bround(F.col("businesses") / 4.0, 0).cast("int"))


def suppressed(c: Column | str) -> Column:
    """A benchmark figure; dots, x, F and blanks mean that it was withheld."""
    text = F.trim(S.col(c))
    return F.when(~text.isin("", ".", "..", "...", "x", "X", "F"), F.regexp_replace(text, "[,%$ ]", "").try_cast("double"))


def cube_errors(cells: DataFrame) -> DataFrame:
    """Cells that are out of range or whose quartiles are out of order. cells: naics, bucket, pct, q1, median, q3."""
    bad = F.array_compact(F.array(F.when((F.col("pct") < 0) | (F.col("pct") > 100), F.lit("range")), F.when((F.col("q1") > F.col("median")) | (F.col("median") > F.col("q3")), F.lit("order"))))
    return cells.select("naics", "bucket", F.explode(bad).alias("error"))


def relevance(docs: DataFrame, text: str = "text", filename: str = "filename") -> DataFrame:
    """Adds six factors counted by patterns, their weighted score, and whether the document is taken, with the reason if not."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = lambda pattern, flag="(?i)": F.regexp_count(t, F.lit(flag + pattern))

    def steps(count: Column, *pairs: tuple[int, float], other: float = 0.0) -> Column:
        out = F.when(count >= pairs[0][0], pairs[0][1])
        for least, score in pairs[1:]:
            out = out.when(count >= least, score)
        return out.otherwise(other)

    named = n(r"(?:from|to|payee|vendor|merchant|client|customer)\s*[:\-]?\s*[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*", "")
    company = t.rlike(r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3}\s+(?:Inc|LLC|Ltd|Corp|Co\b)")
    counted = docs.withColumns({"_business": n(X.BUSINESS_PATTERN), "_rails": n(X.RAIL_PATTERN), "_personal": n(X.PERSONAL_PATTERN), "_parties": n(X.PARTY_PATTERN) + named, "_size": F.length(F.trim(t))})
    own = F.greatest(F.col("_business") - F.col("_rails"), F.lit(0))
    factors = {
        "monetary_amount": steps(n(X.MONEY_PATTERN), (3, 1.0), (2, 0.8), (1, 0.5)),
        "transaction_parties": steps(F.col("_parties"), (2, 1.0), (1, 0.6), other=0.0),
        "transaction_date": steps(n(X.DATE_PATTERN), (2, 1.0), (1, 0.7)),
        "business_relevance": F.when(F.col("_personal") > 0, 0.0).when(own >= 3, 1.0).when(own >= 1, 0.7).otherwise(0.4),
        "document_structure": steps(n(X.STRUCTURE_PATTERN), (4, 1.0), (2, 0.7), (1, 0.4)),
        "completeness": steps(F.col("_size"), (500, 1.0), (200, 0.7), (50, 0.4)),
    }
    factors["transaction_parties"] = F.when(F.col("_parties") > 0, factors["transaction_parties"]).when(company, 0.5).otherwise(0.1)
    out = counted.withColumns(factors)
    out = out.withColumn("score", sum(F.col(k) * w for k, w in X.RELEVANCE_WEIGHTS.items()))
    label = r"(?i)\bnon[\s\-]?financial\b"
    reason = (
        F.when(t.rlike(label) | F.coalesce(F.col(filename).rlike(label), F.lit(False)), "non_financial").when(F.col("monetary_amount") == 0, "no_amount").when(F.col("completeness") == 0, "blank")
        .when(F.col("_personal") > 0, "personal").when(F.col("score") < X.RELEVANCE_THRESHOLD, "low_score")
    )
    return out.withColumn("reason", reason).withColumn("included", F.col("reason").isNull()).drop("_business", "_rails", "_personal", "_parties", "_size")
