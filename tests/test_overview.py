"""Payload scalars, statement readers, contradictions and overview aggregates on hand-made rows."""

import datetime
import random
import re

from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.functions import tables as X
from ledgerloom.operators import categorise as C
from ledgerloom.operators import contradiction as N
from ledgerloom.operators import linkage as L
from ledgerloom.operators import overview as O
from ledgerloom.operators import predicates as P
from ledgerloom.sources import statements


def one(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_alternate_amount_and_payment_date(spark):
    rows = [('{"amount": "$1,370.00"}', "1000.00"), ("{'amount': '12.50'}", "10"), ('{"amount": "10.00"}', "-10"), ('{"amount": "null"}', "1"), ("not json", "1"), (None, "1"), ('{"amount": 5}', None), ('{"amount": "-3"}', "1")]
    df = spark.createDataFrame(rows, "raw string, total string")
    assert [str(x) if x is not None else None for x in one(df, S.alternate_amount("raw", "total"))] == ["1370.00", "12.50", None, None, None, None, None, None]
    rows = [('{"payment_date": "2024-05-06"}', "on March 1", "2024-01-01"), (None, "Bank account on February 02", "2023-12-30"), (None, "paid by Feb 3, 2022", None), ("x", "charged 2024-07-08", None), (None, None, None), (None, "on nothing 12", "2024-01-01")]
    df = spark.createDataFrame(rows, "raw string, method string, at string")
    assert one(df, S.payment_date("raw", "method", "at")) == [datetime.date(2024, 5, 6), datetime.date(2023, 2, 2), datetime.date(2022, 2, 3), datetime.date(2024, 7, 8), None, None]


def test_line_items_and_extraction_verdict(spark):
    items = ['[{"description": "Pen", "quantity": "2", "amount": "3.00"}, {"name": "Ink"}, {"total": "9"}, {}]', "plain text", None, "[" + ", ".join('{"name": "n%d"}' % k for k in range(9)) + "]"]
    assert one(spark.createDataFrame([(x,) for x in items], "i string"), S.line_items_text("i")) == ["2x Pen (3.00); Ink; 9", "plain text", "", "n0; n1; n2; n3; n4"]
    df = spark.createDataFrame([("11.30", None, "10.00", "1.30"), ("11.30", None, "10.00", "1.00"), (None, "7", None, None), (None, None, None, None), ("0.00", None, None, None)], "t string, a string, s string, x string")
    out = one(df, S.extraction_verdict("t", "a", "s", ["x"]))
    assert [(r.valid, float(r.total), r.mismatch) for r in out] == [(True, 11.3, False), (True, 11.3, True), (True, 7.0, False), (False, 0.0, False), (True, 0.0, False)]


def test_previous_period():
    d = datetime.date
    assert S.previous_period(d(2024, 3, 1), d(2024, 3, 31)) == (d(2024, 2, 1), d(2024, 2, 29))
    assert S.previous_period(d(2024, 1, 1), d(2024, 1, 31)) == (d(2023, 12, 1), d(2023, 12, 31))
    assert S.previous_period(d(2024, 3, 5), d(2024, 3, 7)) == (d(2024, 3, 2), d(2024, 3, 4))


def contradicted(spark, rows):
    """{texts: whether the line names another merchant}"""
    out = N.with_contradiction(spark.createDataFrame(rows, "d string, v string, f string"), "d", "v", "f").collect()
    return {(r.d, r.v, r.f): r.contradicted for r in out}


def test_contradictions(spark):
    fine = [("POS PURCHASE 0000", "Orchid Telecom", ""), ("PAYPAL *ORCHID TELECOM", "Orchid Telecom", ""), ("WHOLESALE CLUB", "", ""), ("WHOLESALE CLUB", "Cedarview", "wholesale_march.pdf"), ("AMZN MKTP CA", "Amazon.ca", ""), (None, None, None)]
    bad = [("WHOLESALE CLUB #0000", "Orchid Telecom", "receipt.pdf"), ("AMZN MKTP CA", "Cedarview Supplies", "")]  # of the last a known vendor, though no word has to differ
    got = contradicted(spark, fine + bad)
    assert [got[x] for x in fine + bad] == [False] * len(fine) + [True] * len(bad)


def test_contradictions_match_a_loop(spark):
    rng = random.Random(9)
    parts = ["ORCHID", "telecom", "Cedarview", "supplies", "AMZN MKTP", "amazon.ca", "POS", "purchase", "PAYPAL", "wise payments", "cedar", "clubs", "wholesale", "cl", "0042", "Tel", "bluepek", "software", "visa", "transfer"]
    text = lambda n: " ".join(rng.choices(parts, k=rng.randint(0, n)))
    rows = sorted({(text(4), text(3), text(2)) for _ in range(500)})
    words = lambda x, *lists: [w for w in re.findall("[a-z]{3,}", x.lower()) if not any(w in k for k in lists)]
    label = lambda d: " ".join([w for w in re.findall("[A-Za-z]{3,}", d) if w.lower() not in X.BANK_NOISE and w.lower() not in X.PAYMENT_RAILS][:3])
    texts = sorted({label(d) for d, _, _ in rows} | {v for _, v, _ in rows})
    keys = {r.t: r.k for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.vendor_key("t").alias("k")).collect()}

    def loop(d, v, f):
        printed, sold = words(d, X.BANK_NOISE, X.PAYMENT_RAILS), set(words(v, X.BANK_NOISE))
        receipt = sold | set(words(f, X.BANK_NOISE))
        if not printed or not receipt or receipt & set(printed) or any(len(p) > 3 and len(r) > 3 and (p in r or r in p) for p in printed for r in receipt):
            return False
        known = [p for p, _ in X.VENDOR_ALIASES if re.search(p, label(d), re.I)]
        if (keys[label(d)] and keys[label(d)] == keys[v]) or any(re.search(p, v, re.I) for p in known) or any(re.search(p, d, re.I) for p in X.INTERMEDIARIES):
            return False
        name = " ".join(sorted(sold)) or v
        return bool(known) or any(max([L.indel(w, r) for r in receipt] + [L.partial_indel(w, name)]) < 50 for w in printed if len(w) > 3)

    got = contradicted(spark, rows)
    assert got == {x: loop(*x) for x in rows} and 50 < sum(got.values()) < len(rows) - 50


def test_best_date_of_a_receipt(spark):
    d = datetime.date
    names = ["Dec2026.pdf", "bill nov 2026", "2026 Dec scan", "Dec252026.pdf", "Dec 252026", "Jan1999 and 2026 Feb", "2026-12.pdf", "", None, "Decade2026"]
    assert [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(names)], "k int, n string").orderBy("k").select(S.filename_hint("n")).collect()] == [d(2026, 12, 15), d(2026, 11, 15), d(2026, 12, 15), d(2026, 12, 15), None, d(2026, 2, 15), None, None, None, None]
    rows = [("2026-11-03", None, "Dec2026.pdf"), ("2026-11-03", None, "Feb2027.pdf"), ("2026-11-03", None, "Oct2026.pdf"), (None, None, "Oct2026.pdf"), ("2026-11-30", None, "Jan2027"), ("2026-11-03", "card on December 01, 2026", "x"), ("2026-11-03", "card on December 1, 2026", "Jan2027"), (None, None, "x"), ("2026-11-03", None, "Nov2026")]
    got = [r[0] for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, d string, m string, f string").orderBy("k").select(S.best_date(F.lit(None).cast("string"), "m", "d", "f")).collect()]
    assert got == [d(2026, 12, 15), d(2026, 11, 3), d(2026, 11, 3), d(2026, 10, 15), d(2027, 1, 15), d(2026, 12, 1), d(2027, 1, 15), None, d(2026, 11, 3)]


def pair_rows(spark):
    t = [(1, 1, "2024-03-10", "100.00", "CAD", "Orchid Telecom 55"), (1, 2, "2023-01-01", "100.00", "CAD", "x"), (1, 3, "2024-03-10", "500.00", "CAD", "Bluepeak Software"), (1, 4, "2024-03-10", "1370.00", "CAD", "Harbour Line")]
    txns = spark.createDataFrame([(u, i, a, "CAD", c, "DEBIT", d, "UNMATCHED", x) for u, i, d, a, c, x in t], "user_id long, id long, amount string, account string, currency string, transaction_type string, date_posted string, status string, description string")
    d = [(1, 10, "Orchid Telecom", "2024-03-11", "100.00", "CAD", "stated", "a.pdf", None), (1, 11, "Bluepeak Software", "2024-03-10", "500.01", "CAD", "stated", "b.pdf", None), (1, 12, "Harbour Line", "2024-03-10", "200.00", "USD", "stated", "c.pdf", '{"amount": "1370.00"}')]
    docs = spark.createDataFrame(d, "user_id long, id long, vendor string, document_date string, total string, currency string, currency_source string, original_filename string, raw_json string")
    return txns, docs


def test_settled_without_judgement_and_second_amounts(spark):
    txns, docs = pair_rows(spark)
    pairs = L.scored(L.candidates(txns, docs))
    rows = {(r.transaction_id, r.document_id): r for r in pairs.collect()}
    assert rows[(4, 12)].match_reason == "alt_amount" and rows[(4, 12)].amount_score == 0.95
    # row 2 has the same figure a year before, so receipt 10 has two candidates
    assert sorted(map(tuple, L.unambiguous(txns, docs, pairs).select("transaction_id", "document_id").collect())) == [(3, 11)]
    flagged = L.classified(pairs.withColumn("contradicted", F.lit(True))).select("decision", "reasons").distinct().collect()
    assert {r.decision for r in flagged} == {"FLAGGED"} and all("merchant" in r.reasons for r in flagged)


def test_generic_text_and_ladder(spark):
    text = "Opening 5.00\n2024-01-02 COFFEE BAR -4.50\n01/03/2024 x 9.00\n2024-01-05  PAYROLL $1,200.00\n"
    texts = spark.createDataFrame([("usd_a.txt", text), ("b.txt", "Jan 5, 2024 ONE LINE 3.00"), ("c.txt", "3/4 A -1.00\n3/5/24 B 2.00"), ("d.txt", None)], "file string, text string")
    out = statements.generic_text(texts, 2023)
    got = sorted(tuple(r) for r in out.select("source_file", "account", "transaction_type", "date_posted", "amount", "description").collect())
    assert got == [
        ("c.txt", "CAD", "CREDIT", "2024-03-05", "2.00", "B"), ("c.txt", "CAD", "DEBIT", "2023-03-04", "-1.00", "A"),
        ("usd_a.txt", "USD", "CREDIT", "2024-01-05", "1200.00", "PAYROLL"), ("usd_a.txt", "USD", "DEBIT", "2024-01-02", "-4.50", "COFFEE BAR"),
    ]
    first = out.where("source_file = 'c.txt'").limit(1)
    assert statements.first_reading(first, out).count() == 3
    assert statements.generic_text(texts.where("false"), 2023).count() == 0


def test_transfer_service_rows(spark):
    body = '{"transactions": [{"type": "DEBIT", "date": "2024-02-03T10:00:00Z", "referenceNumber": "TRANSFER-1", "amount": {"value": -3.25, "currency": "EUR"}, "details": {"type": "FEE", "description": "Cost of TRANSFER-1"}}, {"type": "CREDIT", "date": "2024-02-04T00:00:00Z", "amount": {"value": 10}, "details": {}}, {"date": "2024-02-05", "referenceNumber": "R2", "amount": {"value": 0}, "details": {"type": "FEES", "description": "Charges for: R2"}}]}'
    out = statements.transfer_service(spark.createDataFrame([(body,), ("broken",), (None,)], "json string"))
    got = [tuple(r) for r in out.select("transaction_type", "date_posted", "amount", "currency", "description").collect()]
    assert got == [("DEBIT", "2024-02-03", "-3.25", "EUR", "Wise fee: Cost of TRANSFER-1"), ("CREDIT", "2024-02-04", "10.00", "USD", "Wise transaction CREDIT"), ("CREDIT", "2024-02-05", "0.00", "USD", "Charges for: R2")]
    assert one(out, F.col("source_row"))[1] == 2


def test_summary_lines_and_rules(spark):
    df = spark.createDataFrame([("opening balance ", "v"), ("Opening Balance x", "Acme"), (None, None)], "description string, vendor string")
    assert one(df, P.summary_line()) == [True, False, False]
    out = one(df, P.priority_category([("acme", "A", 1), ("opening", "B", 2), ("open", "C", 2)]))
    assert [tuple(r) for r in out] == [("B", "rule"), ("B", "rule"), ("Others", "default")]
    assert [tuple(r) for r in one(df, P.priority_category([]))] == [("Others", "default")] * 3


def test_missing_proof_causes_and_statements(spark):
    txns = spark.createDataFrame([(1, i, "MATCHED", "2024-01-01") for i in range(1, 6)] + [(1, 9, "UNMATCHED", "2024-01-01")], "user_id long, id long, status string, date_posted string")
    matches = spark.createDataFrame([(1, 1, 10, "AUTO_APPROVED"), (1, 2, 11, "USER_APPROVED"), (1, 3, 12, "AUTO_APPROVED"), (1, 4, 10, "PENDING_REVIEW"), (1, 5, 11, "AUTO_APPROVED"), (1, 5, 12, "AUTO_APPROVED")], "user_id long, transaction_id long, document_id long, status string")
    receipts = spark.createDataFrame([(1, 10, "a.pdf"), (1, 11, " "), (1, 12, "gone.pdf")], "user_id long, id long, original_filename string")
    got = {r.id: r.why for r in O.missing_proofs(txns, matches, receipts, receipts.where("id = 10")).collect()}
    assert got == {2: O.NO_PATH, 3: O.GONE, 4: O.NO_MATCH, 5: f"{O.GONE}; {O.NO_PATH}"}
    assert {r.id for r in O.missing_proofs(txns, matches, receipts).collect()} == {2, 4}
    s = spark.createDataFrame([(1, 1, "2024-01-31", 1), (1, 2, None, 2), (1, 3, "2024-02-29", 3)], "user_id long, id long, period_end string, created_at long")
    assert [r.id for r in O.statement_list(s, 2).orderBy("place").collect()] == [2, 3]


def test_industry_by_spending(spark):
    spend = spark.createDataFrame([(1, "cost_of_sales", 40.0), (1, "rent", 60.0), (2, "it_software", 5.0), (2, "travel", 95.0), (3, "travel", 1.0), (4, "cost_of_sales", 30.0), (4, "subcontracts", 70.0), (5, "transfer", 9.0)], "user_id long, bucket string, amount double")
    assert {r.user_id: r.inferred for r in C.inferred_naics(spend).collect()} == {1: "7225", 2: "5415", 4: "2361"}
    profiles = spark.createDataFrame([(1, "", "Unknown"), (2, "1111", None), (3, None, " Food & Hospitality "), (5, None, None)], "user_id long, naics_code string, industry_label string")
    assert {r.user_id: (r.naics, r.naics_source) for r in C.resolved_naics(profiles, spend).collect()} == {1: ("7225", "data_inferred"), 2: ("1111", "profile"), 3: ("7225", "industry_map"), 5: (None, None)}
