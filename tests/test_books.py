"""Page batches, hand-kept sheets, quotes, interval counts, review actions and the cube: rules against plain loops."""

import datetime
import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import tables as X
from ledgerloom.operators import cube, intervals, linkage, pages, quotes
from ledgerloom.sources import sheets
from ledgerloom.streaming import actions

# page batches


def is_blank(v):
    return v is None or (isinstance(v, str) and v.strip().lower() in ("", "null", "none", "n/a"))


def money(v):
    try:
        return Decimal(str(v).strip().replace("$", "").replace(",", "").replace(" ", "").rstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") or 0)
    except ArithmeticError:
        return Decimal(0)


def loop_merge(batches):
    """batches: (batch, last page, answer) in order."""
    out = {}
    ordered = [b for b in batches if str(b[2].get("continuation")).lower() not in ("true", "yes", "1")]
    ordered += [b for b in batches if b not in ordered]
    for f in X.IDENTITY_FIELDS:
        out[f] = next((r[f] for _, _, r in ordered if not is_blank(r.get(f)) and not (f == "vendor" and r[f].strip() == X.NOT_FINANCIAL)), None)
    if out["vendor"] is None and any((r.get("vendor") or "").strip() == X.NOT_FINANCIAL for _, _, r in batches):
        out["vendor"] = X.NOT_FINANCIAL
    claims, back = [], None
    for k, last_page, r in batches:
        raw = r.get("amount") if is_blank(r.get("total")) else r["total"]
        if money(raw) == 0:
            continue
        back = (raw, r)
        page = r.get("grand_total_page")
        if not is_blank(page) and str(page).isdigit() and int(page) > 0:
            claims.append((int(page), k, money(raw), raw, r))
        elif str(r.get("has_grand_total")).lower() in ("true", "yes"):
            claims.append((last_page, k, money(raw), raw, r))
    claims.sort(key=lambda c: c[:2])
    own = claims[-1][3:] if claims else back
    out["total"] = own[0] if own else None
    for f in X.TOTAL_SIBLINGS:
        v = own[1].get(f) if own else None
        out[f] = v if not is_blank(v) else next((r[f] for _, _, r in batches if not is_blank(r.get(f))), None)
    distinct = []
    for c in claims:
        if not any(abs(c[2] - d) <= Decimal("0.02") for d in distinct):
            distinct.append(c[2])
    out["reasons"] = ",".join((["totals_disagree"] if len(distinct) > 1 else []) + ([] if claims else ["no_grand_total"] if back else ["no_amount"]) + (["low_confidence"] if any(r.get("_confidence") == "low" for _, _, r in batches) else []))
    out["items"] = [i["d"] for _, _, r in batches for i in r.get("line_items") or [] if isinstance(i, dict)]
    out["claims"] = [(c[0], c[1], c[2]) for c in claims]
    return out


def test_page_batches_merge_in_any_order(spark):
    rng = random.Random(1)
    texts = {"vendor": [None, "", "N/A", X.NOT_FINANCIAL, "Ann", "Bob"], "total": [None, "", "$10.00", "10.02 CAD", "10.03", "1,000.00", "0", "x"], "amount": [None, "null", "9.00", "0.00"], "gst": [None, "none", "0.50", "0.70"], "currency": [None, "CAD", "USD"]}
    rows, want = [], {}
    for d in range(150):
        batches = []
        for k in range(rng.randint(1, 5)):
            r = {f: rng.choice(v) for f, v in texts.items()} | {"continuation": rng.choice([True, False, "yes", None]), "grand_total_page": rng.choice([None, None, "", 2, "3", "0", "p1"]), "has_grand_total": rng.choice([None, True, "Yes", False]), "_confidence": rng.choice([None, None, None, "low"])}
            r["line_items"] = rng.choice([None, [], [{"d": f"{d}.{k}"}], ["text", {"d": f"{d}.{k}"}, 3, {"d": "again"}]])
            batches.append((k, 2 * k + 2, r))
        want[d] = loop_merge(batches)
        rows += [(1, d, k, p, json.dumps(r)) for k, p, r in batches]
    rng.shuffle(rows)
    rows.append((1, 900, 0, 1, None))
    out = pages.merged(pages.batches(spark.createDataFrame(rows, "user_id long, document_id long, batch int, last_page int, json string").repartition(5))).collect()
    for r in out:
        if r.document_id == 900:
            assert r.reasons == "no_amount" and r.vendor is None and r.line_items == []
            continue
        w = want[r.document_id]
        assert {f: r[f] for f in (*X.IDENTITY_FIELDS, *X.TOTAL_SIBLINGS, "total", "reasons")} == {f: w[f] for f in (*X.IDENTITY_FIELDS, *X.TOTAL_SIBLINGS, "total", "reasons")}
        assert [json.loads(x)["d"] for x in r.line_items] == w["items"] and [tuple(c) for c in r.claims] == w["claims"]
    assert len(out) == 151 and sum("disagree" in r.reasons for r in out) > 10


# sheets


def test_stacked_sections(spark):
    bank = [
        ["report of 2001", None, None], [None, None, None], ["20010101", "DEBIT", "-1.00"],
        ["Transaction Type", "Date Posted", "Transaction Amount", "Description", "Invoice/Cheque", "Note"],
        ["debit", "20010102.0", "-5.00", " Tea ", "17", None], [None, "20010103", "$1,000.00", "Pay", None, "n"], ["", "20010104", "-", "no amount"], ["CREDIT", "2001-01-05 00:00:00", "2.5", None], ["DEBIT", "200101", "-1"],
        [None, "sum of all", None, None], ["DEBIT", "20010106", "-9.00", "after the sum"],
        ["Date Posted", "Description", "Transaction Amount (USD)", "Category", "Transaction Type"], ["20010107", "Fee", "-3.00", "Bank fees"], ["20010108", "Short row"], ["20010109", "Odd", "-3.00", "Own", "Debit", "extra"],
    ]
    card = [["stamp"], ["Transaction Date", "Posting Date", "Description", "Transaction Amount CAD", "Category"], ["20010101", "20010102", "Shop", "10.00", "office supplies"], ["20010101", None, "No posting date", "1.00"], ["20010103", "20010104", "Back", "4.00 CR"], ["Transaction Date", "Posting Date", "Description", "Transaction Amount"], ["20010105", "20010106", "SUM is a word here", "-2.00"]]
    old = [["Transaction Date", "Description", "Transaction Amount", "posting date?"][:3], ["20010101", "x", "1"]]
    rows = [("f", name, k, c) for name, body in (("Bank CAD USD", bank), ("My Credit Card", card), ("Notes on bank", bank), ("Other", bank), ("card without header", old)) for k, c in enumerate(body, 1)] + [("f", "Bank CAD USD", 99, None)]
    got = [tuple(r) for r in sheets.read(spark.createDataFrame(rows, sheets.CELLS)).drop("file").orderBy("sheet", "row").collect()]
    s, c = "Bank CAD USD", "My Credit Card"
    assert got == [
        ("CAD", "DEBIT", "2001-01-02", "-5.00", "Tea", "", "17", "", s, 5), ("CAD", "CREDIT", "2001-01-03", "1000.00", "Pay", "", "", "n", s, 6), ("CAD", "CREDIT", "2001-01-05", "2.50", "", "", "", "", s, 8),
        ("USD", "DEBIT", "2001-01-07", "-3.00", "Fee", "Interest and bank charges", "", "", s, 13), ("USD", "DEBIT", "2001-01-09", "-3.00", "Odd", "Own", "", "", s, 15),
        ("CreditCard", "DEBIT", "2001-01-02", "10.00", "Shop", "Office supplies", "", "", c, 3), ("CreditCard", "CREDIT", "2001-01-04", "-4.00", "Back", "", "", "", c, 5), ("CreditCard", "CREDIT", "2001-01-06", "-2.00", "SUM is a word here", "", "", "", c, 7),
        ("CreditCard", "DEBIT", "2001-01-01", "1.00", "x", "", "", "", "card without header", 2),
    ]


def test_benchmark_files(spark):
    head = ["NAICS", "", "Prov", "Whole industry\nReliability count", "Quality indicator", "Rent", "Quality", "Bottom Quartile x", "Lower Middle", "Upper Middle", "Top Quartile", "%", "Insurance ", "Value", "Rent"]
    low = ["Bottom quartile low revenue range ($000)", "Bottom quartile high revenue range"]
    rows = [("a", 0, head), ("a", 1, ["54 ", "n", "00", "1,200", "B", "5.0", "A", "1", "2", "9999", "4", "90", "7%", "z", "8"]), ("b", 5, ["x", "y", "z", "bottom quartile", *low]), ("b", 6, ["54", "", "35", "999999.0", "30", "99999.9"]), ("c", 0, ["only a header"])]
    df = spark.createDataFrame(rows, "file string, row long, cells array<string>")
    assert [tuple(r) for r in sheets.benchmark_lines(df).orderBy("bucket").collect()] == [("a", 1, "54", "00", "insurance", 0.07, None, None, None, None, None), ("a", 1, "54", "00", "rent", 0.05, "A", 0.01, 0.02, None, 0.04)]
    got = {r.file: r for r in sheets.benchmark_revenue(df).collect()}
    assert (got["a"].businesses, got["a"].quality, got["a"].low1) == (1200, "B", None) and (got["b"].businesses, got["b"].low1, got["b"].high1) == (None, 30000.0, None)


# quotes


def test_quotes_are_carried_to_later_days(spark):
    day = lambda d: datetime.date(2001, 1, d) if d else None
    rows = [(1, "USD", day(1)), (2, "USD", day(3)), (3, "USD", day(3)), (4, "USD", day(9)), (5, "CAD", day(1)), (6, "GBP", day(4)), (7, None, day(4)), (8, "USD", None), (9, "EUR", day(30)), (3, "USD", day(3))]
    df = spark.createDataFrame(rows, "id long, currency string, day date").withColumn("v", F.lit("10.00").cast("decimal(18,2)")).withColumn("asked", F.lit("own"))
    q = spark.createDataFrame([("USD", day(2), "1.30"), ("USD", day(5), "1.40"), ("USD", day(5), "1.35"), ("EUR", day(30), "1.50"), ("GBP", day(5), "2"), ("JPY", day(1), "3"), ("USD", day(7), None)], "currency string, day date, r string").select("currency", "day", F.col("r").cast("decimal(12,6)").alias("rate"))
    got = sorted((r.id, r.rate and float(r.rate), r.as_of and r.as_of.day, r.in_base and float(r.in_base)) for r in quotes.converted(df, q, "v").collect())
    assert got == [(1, None, None, None), (2, 1.3, 2, 13.0), (3, 1.3, 2, 13.0), (3, 1.3, 2, 13.0), (4, 1.4, 5, 14.0), (5, 1.0, 1, 10.0), (6, None, None, None), (7, None, None, None), (8, None, None, None), (9, 1.5, 30, 15.0)]
    assert quotes.missing(df, q.where("currency <> 'GBP'")).collect() == [("GBP",)]


# interval counts


def test_points_are_counted_in_intervals(spark):
    rng = random.Random(3)
    points = [(rng.choice("ab"), rng.choice([None, 0, 5, 6, 7, 100, 10**7, *range(200, 230)])) for _ in range(500)]
    asked = [(i, rng.choice("abc"), [(lo := rng.choice([-5, 0, 4, 6, 205, 10**7 - 3]), lo + rng.choice([-3, 0, 1, 20, 10**8])) for _ in range(rng.randint(0, 4))]) for i in range(80)]
    df = spark.createDataFrame(asked, "who long, k string, s array<struct<lo:long,hi:long>>").withColumn("spans", intervals.disjoint(F.col("s")))
    for r in df.collect():
        assert all(a.hi + 1 < b.lo for a, b in zip(r.spans, r.spans[1:], strict=False))
    got = {r.who: r.n for r in intervals.counted(spark.createDataFrame(points, "k string, x long"), df, ["k"], ["who"]).collect()}
    assert got == {i: sum(x is not None and k == j and any(lo <= x <= hi for lo, hi in s) for j, x in points) for i, k, s in asked}


def test_counted_candidates_equal_the_listed_ones(spark):
    rng = random.Random(5)
    money = lambda: f"{rng.choice([10, 11.5, 12, 12.02, 13.9, 15, 18.6, 100, 101, 118]):.2f}"
    txns = [(rng.choice([1, 2]), i, rng.choice(["CAD", "USD", "CreditCard"]), rng.choice(["CAD", "USD", "EUR"]), "DEBIT", "2001-01-0" + str(rng.randint(1, 9)), "-" + money(), rng.choice(["WISE PAYMENTS", "Shop", f"Shop {money()} USD", f"USD {money()}@1.3"]), rng.choice(["UNMATCHED", "MATCHED"])) for i in range(120)]
    docs = [(rng.choice([1, 2, 3]), 1000 + i, "Shop", f"2001-01-0{rng.randint(1, 9)}", money(), rng.choice(["CAD", "USD"]), "stated", None, None, json.dumps({"amount": money()}) if i % 3 == 0 else None) for i in range(60)]
    t = spark.createDataFrame(txns, "user_id long, id long, account string, currency string, transaction_type string, date_posted string, amount string, description string, status string")
    r = spark.createDataFrame(docs, "user_id long, id long, vendor string, document_date string, total string, currency string, currency_source string, original_filename string, file_hash string, raw_json string")
    pairs = linkage.candidates(t, r, max_days=1000)
    listed = {}
    for p in pairs.collect():
        listed.setdefault(p.document_id, set()).add(p.transaction_id)
    asked = r.select("user_id", F.col("id").alias("document_id"), F.col("currency").alias("doc_ccy"), linkage.cents(F.col("total").cast("decimal(18,2)")).alias("doc_c"), linkage.cents(linkage.S.alternate_amount("raw_json", "total")).alias("alt_c"))
    seen = set()
    for c in linkage.candidate_counts(t, asked).collect():
        n = len(listed.get(c.document_id, ()))
        assert max(c.n, c.n_printed) <= n <= c.n + c.n_printed
        if c.n_printed == 0:
            assert c.n == n
        seen.add(min(n, 3))
    assert seen >= {0, 3}


# review actions


def log(seed):
    rng = random.Random(seed)
    rows, seq = [], 0
    for t in range(40):
        known = [t * 100]
        rows.append((1, t, 0, "LOAD", t * 100, t + 1000, None, rng.choice(["AUTO_APPROVED", "PENDING_REVIEW", "USER_REJECTED"]), None))
        for _ in range(rng.randint(0, 6)):
            seq += 1
            new = t * 100 + len(known) + rng.choice([0, 0, -1])
            kind = rng.choice(["REASSIGN", "REMOVE_PROOF", "SUPERSEDE", "ADD_PROOF", "MANUAL_MATCH", "SHOUT"])
            make = kind in ("ADD_PROOF", "MANUAL_MATCH")
            rows.append((1, t, seq, kind, new if make else rng.choice([*known, 99_999]), rng.randint(1000, 1050) if make or kind == "REASSIGN" else None, new if kind == "REASSIGN" else None, None, "r"))
            known.append(new)
    return rows


def loop_fold(rows):
    held, audit = {}, []
    for u, t, seq, kind, m, d, n, status, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        old = held.get((t, m))
        ok, before = True, None
        if kind in ("LOAD", "ADD_PROOF", "MANUAL_MATCH"):
            ok = old is None
            if ok:
                held[t, m] = [d, status or "USER_APPROVED", {"ADD_PROOF": "add_proof", "MANUAL_MATCH": "manual_match"}.get(kind), "MANY_TO_ONE" if kind == "ADD_PROOF" else "ONE_TO_ONE"]
        elif kind in ("REASSIGN", "REMOVE_PROOF", "SUPERSEDE"):
            ok = old is not None and (kind == "SUPERSEDE" or old[1] != "USER_REJECTED") and not (kind == "REASSIGN" and (t, n) in held)
            if ok:
                before = old[1]
                old[1:3] = ["USER_REJECTED", {"REASSIGN": "reassigned", "REMOVE_PROOF": "remove_proof", "SUPERSEDE": "superseded"}[kind]]
                if kind == "REASSIGN":
                    held[t, n] = [d, "USER_APPROVED", "manual_match", "ONE_TO_ONE"]
                left = [v for (x, _), v in held.items() if x == t and v[1] != "USER_REJECTED"]
                if kind == "REMOVE_PROOF" and len(left) == 1:
                    left[0][3] = "ONE_TO_ONE"
        else:
            ok = False
        audit.append((t, seq, kind, m, ok, before))
    return {k[1]: tuple(v) for k, v in held.items()}, sorted(audit, key=str)


def summary(rows):
    return {r.match_id: (r.document_id, r.status, r.user_action, r.match_type) for r in rows if r["kind"] == "match"}, sorted(((r.transaction_id, r.seq, r.action, r.match_id, r.outcome == "applied", r.old_value) for r in rows if r["kind"] == "audit"), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_actions_folded_as_batch_and_as_stream(spark, tmp_path, seed):
    rows = log(seed)
    want = loop_fold(rows)
    df = spark.createDataFrame(rows, actions.EVENTS)
    assert summary(actions.fold(df).collect()) == want
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for lo, hi in ((0, 1), (1, 40), (40, 1000)):
        df.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(src)
    events = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def keep(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)

    actions.stream(events).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(out)
    assert summary(got.collect())[1] == want[1]
    assert {r.match_id: (r.document_id, r.status, r.user_action, r.match_type) for r in actions.latest(got).collect()} == want[0]


def test_statuses_follow_for_ends_that_changed(spark):
    ev = [(1, 1, 0, "LOAD", 10, 100, None, "AUTO_APPROVED", None), (1, 1, 1, "REASSIGN", 10, 101, 11, None, None), (1, 2, 0, "LOAD", 20, 100, None, "PENDING_REVIEW", None), (1, 3, 0, "LOAD", 30, 102, None, "AUTO_APPROVED", None), (1, 3, 2, "REMOVE_PROOF", 30, None, None, None, None), (1, 4, 0, "LOAD", 40, 103, None, "AUTO_APPROVED", None), (1, 5, 0, "LOAD", 50, 104, None, "AUTO_APPROVED", None), (1, 5, 3, "SUPERSEDE", 50, None, None, None, "x"), (1, 6, 4, "ADD_PROOF", 60, 105, None, None, None), (1, 7, 5, "ADD_PROOF", 70, 106, None, None, None)]
    t = spark.createDataFrame([(1, 1, "UNMATCHED"), (1, 2, "UNMATCHED"), (1, 3, "MATCHED"), (1, 4, "UNMATCHED"), (1, 5, "MATCHED"), (1, 6, "EXCLUDED"), (1, 7, "IGNORED")], "user_id long, id long, status string")
    d = spark.createDataFrame([(1, 100, "MATCHED"), (1, 101, "EXTRACTED"), (1, 102, "MATCHED"), (1, 103, "EXTRACTED"), (1, 104, "FLAGGED"), (1, 105, "EXTRACTED")], "user_id long, id long, status string")
    links = spark.createDataFrame([(1, 1, 5, 9, "PENDING_REVIEW", "X"), (1, 2, 7, 8, "AUTO_APPROVED", "X")], "user_id long, id long, source_transaction_id long, target_transaction_id long, status string, link_type string")
    got = sorted((r.side, r.id, r.status, r.derived) for r in actions.resynced(actions.fold(spark.createDataFrame(ev, actions.EVENTS)), t, d, links).collect())
    assert got == [("receipt", 101, "EXTRACTED", "MATCHED"), ("receipt", 102, "MATCHED", "EXTRACTED"), ("receipt", 105, "EXTRACTED", "MATCHED"), ("transaction", 1, "UNMATCHED", "MATCHED"), ("transaction", 3, "MATCHED", "UNMATCHED"), ("transaction", 5, "MATCHED", "LINKED"), ("transaction", 7, "IGNORED", "LINKED")]


# cube


def test_cube_rules(spark):
    line = lambda c, b, pct, q1=None, m=None, q3=None: (c, "b", "all", b, pct, q1, m, q3)
    lines = spark.createDataFrame([line("1", "rent", 0.5, 0.1, 0.2, 0.3), line("1", "travel", None), line("2", "rent", 8.1), line("2", "travel", -0.1), line("3", "rent", 0.5, 0.3, None, 0.2), line("3", "travel", 0.5, 0.1, 0.4, 0.3), line("3", "x", 0.5, None, 0.4, 0.3), *[line("4", f"l{k}", 7.0) for k in range(3)], line("4", "operating_revenue", 1.0)], "naics string, band string, cohort string, bucket string, pct double, q1 double, median double, q3 double")
    assert sorted((r.naics, r.bucket, r.error) for r in cube.line_errors(lines).collect()) == [("1", "travel", "share"), ("2", "rent", "share"), ("2", "travel", "share"), ("3", "rent", "order"), ("3", "travel", "order")]
    cells = spark.createDataFrame([("1", "b", "all", 0.1, 0.5, 0.5, "A"), ("2", "b", "all", 1.6, 1.1, 1.1, "F"), ("3", "b", "all", None, None, None, None)], "naics string, band string, cohort string, net_profit_margin double, gross_margin double, pct_profitable double, quality string")
    assert sorted((r.naics, r.error) for r in cube.cell_errors(lines, cells).collect()) == [("2", "gross_margin"), ("2", "net_margin"), ("2", "profitable"), ("2", "quality"), ("4", "line_sum")]
    none = cells.select(*cube.KEYS, F.lit("x").alias("error")).limit(0)
    old = lines.where("naics <> '4'").unionByName(lines.where("naics = '1'").withColumn("naics", F.lit("9")))
    assert {r.naics: (r.change, r.n_new, r.n_old) for r in cube.compared(lines, old).collect()} == {"1": ("kept", 2, 2), "2": ("kept", 2, 2), "3": ("kept", 3, 3), "4": ("added", 4, 0), "9": ("removed", 0, 2)}
    said = lambda a, b, e=none: cube.verdict(a, b, e).collect()[0].refused_for
    assert said(lines, old) == "" and said(lines.where("naics < '4'"), old) == "regressed" and said(lines.limit(0), old) == "empty,regressed" and said(lines, old.limit(0), cells.select(*cube.KEYS, F.lit("x").alias("error"))) == "errors"
    anchor = spark.createDataFrame([("1", "b", "all", "rent", 0.51), ("1", "b", "all", "travel", 0.1), ("2", "b", "all", "rent", 8.0), ("7", "b", "all", "rent", 1.0)], "naics string, band string, cohort string, bucket string, expected double")
    assert sorted((r.naics, r.bucket) for r in cube.anchored(lines, anchor).collect()) == [("1", "travel"), ("2", "rent"), ("7", "rent")]
