"""Rules, parsers, scores, assignments, sinks and streaming on hand-made rows."""

import collections
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import categorise as C
from ledgerloom.operators import contradiction as N
from ledgerloom.operators import linkage as L
from ledgerloom.operators import linked as G
from ledgerloom.operators import lookup as U
from ledgerloom.operators import predicates as P
from ledgerloom.operators import reporting as R
from ledgerloom.operators import sequences as Q
from ledgerloom.operators import transfers as T
from ledgerloom.plans.queries import QUERIES
from ledgerloom.plans.views import Views
from ledgerloom.sources import orders, sinks, statements
from ledgerloom.streaming import sync

TXN = "user_id long, id long, account string, currency string, transaction_type string, date_posted string, amount string, description string, status string, category string, note string, source_file string, source_row long"


def txn(i, amount, date="2024-03-10", kind="DEBIT", account="CAD", ccy="CAD", text="x", status="UNMATCHED", category=None, user=1, file="a.csv"):
    return (user, i, account, ccy, kind, date, amount, text, status, category, None, file, i)


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_money_rules(spark):
    rows = [("-12.50",), ("12.5",), ("12.500",), ("$1,234.50",), ("n/a",), (None,), ("(5.00)",), ("7.25CR",)]
    got = values(spark, rows, "x string", S.money("x").cast("string"), S.guarded_money("x").cast("string"), S.clean_amount("x").cast("string"), S.bracketed_money("x").cast("string"))
    assert [g[0] for g in got] == ["-12.50", "12.50", "12.50", None, None, None, None, None]
    assert [g[1] for g in got] == ["-12.50", "12.50", "12.50", "0.00", "0.00", "0.00", "0.00", "0.00"]
    assert got[3][2] == "1234.50" and got[6][3] == "-5.00" and got[7][3] == "-7.25"


def test_amount_rule_edges(spark):
    cases = [("100.00", "CAD", "100.00", "CAD", "exact", 1.0), ("100.00", "CAD", "100.05", "CAD", "rounding", 0.9), ("100.00", "CAD", "100.06", "CAD", "within_tolerance", 0.8), ("100.00", "CAD", "102.00", "CAD", "within_tolerance", 0.8),
             ("100.00", "CAD", "102.01", "CAD", "mismatch", 0.0), ("119.99", "CAD", "100.00", "USD", "mismatch", 0.0), ("120.00", "CAD", "100.00", "USD", "fx_band", 0.78), ("155.00", "CAD", "100.00", "USD", "fx_band", 0.78),
             ("155.01", "CAD", "100.00", "USD", "mismatch", 0.0), ("100.00", "USD", "130.00", "CAD", "fx_band", 0.78), ("100.00", "EUR", "100.00", "CAD", "no_fx_band", 0.0), ("0.00", "CAD", "5.00", "USD", "mismatch", 0.0),
             ("100.00", "CAD", "100.00", None, "assumed_same_currency", 1.0), ("100.00", "CAD", None, "CAD", "unknown", 0.0)]
    d = lambda c: F.col(c).cast("decimal(18,2)")
    out = L.compare_amounts(d("t"), F.col("tc"), d("d"), F.col("dc"))
    got = values(spark, [c[:4] for c in cases], "t string, tc string, d string, dc string", out.getField("verdict"), out.getField("score"))
    assert got == [c[4:] for c in cases]
    diffs = [("0",), ("0.05",), ("0.06",), ("2.00",), ("25.00",), ("25.01",)]
    assert [x[0] for x in values(spark, diffs, "x string", L.amount_score(d("x")))] == [1.0, 0.9, 0.8, 0.8, 0.65, 0.0]
    assert [x[0] for x in values(spark, diffs, "x string", L.amount_score(d("x"), 1.0))] == [1.0, 0.9, 0.8, 0.0, 0.0, 0.0]


def test_date_tiers(spark):
    gaps = [0, 1, 3, 4, 7, 8, 14, 15, 21, 22, 45, 46, 1_000_000]
    assert [x[0] for x in values(spark, [(g,) for g in gaps], "g int", L.date_score(F.col("g")))] == [1.0, 0.9, 0.9, 0.7, 0.7, 0.5, 0.5, 0.4, 0.4, 0.2, 0.2, 0.02, 0.1]


def test_currency_resolution(spark):
    rows = [("USD", "stated", "12.00", "100.00"), ("$", None, None, None), (None, None, "5.00", "100.00"), ("CAD", None, None, None), ("EUR", "inferred", None, None), ("CAD", None, "5.00", "100.00"), ("USD", "assumed", None, None)]
    m = lambda c: F.col(c).cast("decimal(18,2)")
    out = S.resolved_currency(F.col("c"), F.col("s"), S.tax_signal(m("g"), F.lit(None).cast("decimal(18,2)"), F.lit(0), m("t")))
    got = values(spark, rows, "c string, s string, g string, t string", out.getField("currency"), out.getField("source"))
    assert got == [("USD", "stated"), (None, "assumed"), ("CAD", "inferred"), ("CAD", "stated"), ("EUR", "inferred"), ("CAD", "stated"), (None, "assumed")]
    texts = [("Total US$ 5 and USD 5",), ("CAD 5, EUR 6",), ("$5",), ("C$ 9",)]
    assert [x[0] for x in values(spark, texts, "t string", S.text_currency("t"))] == ["USD", None, None, "CAD"]


def test_text_helpers(spark):
    texts = [("Express Checkout Payment Orchid Telecom", "orchid_telecom"), ("AMZN Mktp CA*2K4", "amazon"), ("General Currency Conversion", "paypal_fx"), ("BLUEPEAK SOFTWARE INC", "bluepeak_software"), ("", ""), (None, ""), ("12345678 #55", "")]
    assert [x[0] for x in values(spark, texts, "t string, k string", S.vendor_key("t"))] == [k for _, k in texts]
    cells = [("=1+1", "'=1+1"), ("-5.00", "-5.00"), ("@x", "'@x"), ("ok", "ok"), ("+1,200.50", "+1,200.50"), ("-a", "'-a")]
    assert [x[0] for x in values(spark, cells, "t string, k string", S.csv_safe("t"))] == [k for _, k in cells]
    dates = [("2024-01-05", "2024-01-05"), ("13/02/2024", "2024-02-13"), ("02/03/2024", "2024-02-03"), ("x", "None")]
    assert [str(x[0]) for x in values(spark, dates, "t string, k string", S.wallet_date("t"))] == [k for _, k in dates]
    names = [("inv_2024-03.pdf", "2024-03-15"), ("March_2021 bill", "2021-03-15"), ("05-2022", "2022-05-15"), ("2031-01", "None")]
    assert [str(x[0]) for x in values(spark, names, "t string, k string", S.filename_month("t"))] == [k for _, k in names]
    assert values(spark, [("PAID AT1.3456 x",), ("y @0.2",)], "t string", S.fx_rate("t")) == [(1.3456,), (None,)]


def test_places_and_tax_codes(spark):
    rows = [("SHOP TORONTO ON", "CA"), ("SHOP SEATTLE WA", "FOREIGN"), ("X DEU Y", "FOREIGN"), ("X CAN DEU", "CA"), ("ACME", "UNKNOWN"), ("", "UNKNOWN"), ("UK LTD", "FOREIGN")]
    assert [x[0] for x in values(spark, rows, "t string, k string", S.jurisdiction(F.col("t"), F.lit(None).cast("string")))] == [k for _, k in rows]
    code = S.tax_code(F.col("c"), F.col("k"), F.col("p"), F.col("s"), F.col("l"))
    cases = [("Rent", "expense", "CA", True, True, "GST on Expenses"), ("Rent", "expense", "FOREIGN", False, False, "Zero-rated / No GST"), ("Internal transfer", "transfer", "CA", True, True, "BAS Excluded"), ("Owner's draw", "expense", "CA", True, True, "BAS Excluded"), (None, None, "CA", True, True, ""), ("Sales", "income", "CA", True, True, "GST on Income"), ("Refund/Credit", "contra", "CA", True, True, "")]
    assert [x[0] for x in values(spark, [c[:5] for c in cases], "c string, k string, p string, s boolean, l boolean", code.getField("code"))] == [c[5] for c in cases]


def test_indel_and_contradiction():
    def lcs(a, b):
        best = 0
        for n in range(len(a), 0, -1):
            for c in itertools.combinations(a, n):
                it = iter(b)
                if all(x in it for x in c):
                    return n
        return best

    rng = random.Random(1)
    for _ in range(60):
        a, b = ("".join(rng.choices("abc", k=rng.randint(0, 7))) for _ in range(2))
        want = 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))
        assert L.indel(a, b) == pytest.approx(want)
    assert L.partial_indel("abc", "xxabcxx") == 100.0
    assert L.partial_indel("abcd", "cdx") == 80.0  # against cd, a window cut off at the end


def test_other_merchants(spark):
    rows = [("ORCHID TELECOM 55", "Cedarview Supplies"), ("ORCHID TELECOM", "Orchid Telecom Inc"), ("WISE PAYMENTS 88", "Cedarview Supplies")]
    got = {r.d: r.contradicted for r in N.with_contradiction(spark.createDataFrame(rows, "d string, v string"), "d", "v").collect()}
    assert [got[d] for d, _ in rows] == [True, False, False]


def test_one_edit_patterns():
    p = U.one_edit_patterns("acme")
    assert p[:4] == ["%_cme%", "%a_me%", "%ac_e%", "%acm_%"] and "%cme%" in p and "%a_cme%" in p and len(p) <= 24
    assert U.one_edit_patterns("abc") == [] and len(U.one_edit_patterns("abcdefghijklmnop")) == 24
    assert U.search_id("#12") == 12 and U.search_id("١٢") is None and U.search_amount("-$1,200.50") == "1200.50" and U.regex_candidate("a(") is None


def test_assignment_is_a_total_order(spark):
    rng = random.Random(2)
    rows = [(1, t, d, rng.choice([0.5, 0.7, 0.9]), rng.choice([0.0, 0.8, 1.0]), rng.randint(0, 3), "r") for t in range(12) for d in range(100, 112) if rng.random() < 0.4]
    schema = "user_id long, transaction_id long, document_id long, confidence double, amount_score double, gap int, match_reason string"

    def brute(rows):
        open_rows, out = list(rows), []
        for _ in range(3):
            best = {}
            for r in sorted(open_rows, key=lambda r: (-r[3], r[5], r[1])):
                best.setdefault(r[2], r)
            won = {}
            for r in sorted(best.values(), key=lambda r: (r[3] < 0.6 or r[4] <= 0.05, -r[3], -r[4], r[5], r[2])):
                won.setdefault(r[1], r)
            out += [(r[1], r[2]) for r in won.values()]
            docs = {r[2] for r in won.values()}
            open_rows = [r for r in open_rows if r[1] not in won and r[2] not in docs]
        return sorted(out)

    for seed in range(2):
        random.Random(seed).shuffle(rows)
        got = L.assign(spark.createDataFrame(rows, schema)).select("transaction_id", "document_id").collect()
        assert sorted(map(tuple, got)) == brute(rows)


def test_store_rule(spark):
    e = "user_id long, transaction_id long, document_id long, confidence double, status string"
    old = spark.createDataFrame([(1, 10, 100, 0.5, "PENDING_REVIEW"), (1, 11, 101, 0.7, "PENDING_REVIEW"), (1, 12, 102, 0.5, "USER_APPROVED")], e)
    new = spark.createDataFrame([(1, 20, 100, 0.65), (1, 10, 100, 0.6), (1, 21, 101, 0.99), (1, 22, 102, 0.99), (1, 23, 103, 0.8), (1, 24, 104, 0.8)], "user_id long, transaction_id long, document_id long, confidence double")
    bad = spark.createDataFrame([(1, 24, 104)], "user_id long, transaction_id long, document_id long")
    got = {(r.transaction_id, r.document_id): r.outcome for r in L.store(old, new, bad).collect()}
    assert got == {(20, 100): "displaced", (10, 100): "blocked", (21, 101): "blocked", (22, 102): "blocked", (23, 103): "stored", (24, 104): "skipped_rejected"}


def test_transfer_scores_and_refund_fan_out(spark):
    rows = [txn(1, "-500.00", account="CAD", text="OnlineTransfer,TF0000001234"), txn(2, "500.00", kind="CREDIT", account="CreditCard", text="PAYMENT THANK YOU", date="2024-03-13"), txn(3, "-300.00", account="CAD", text="bulk", category="Internal transfer"), txn(4, "299.50", kind="CREDIT", account="USD", text="TRSF FROM", date="2024-03-11")]
    out = T.scored(T.pairs(T.candidate_rows(spark.createDataFrame(rows, TXN)))).collect()
    first = next(r for r in out if (r.source_id, r.target_id) == (1, 2))
    assert first.link_type == "CREDIT_CARD_PAYMENT" and first.score >= 0.92 and first.status == "AUTO_APPROVED"
    schema = "user_id long, source_id long, target_id long, link_type string, score double, status string, a_transaction_type string, a_abs decimal(18,2), b_abs decimal(18,2), a_date_posted string, a_id long, b_date_posted string, b_id long, a_currency string, b_currency string"
    from decimal import Decimal as D

    legs = [(1, 1, t, "REFUND", 0.8 - t / 1000, "PENDING_REVIEW", "DEBIT", D(300), D(100), "2024-01-01", 1, "2024-01-02", t, "CAD", "CAD") for t in range(10, 15)]
    legs.append((1, 50, 10, "FX_CONVERSION", 0.5, "PENDING_REVIEW", "DEBIT", D(100), D(100), "2024-01-01", 50, "2024-01-02", 10, "CAD", "CAD"))
    got = T.assign(spark.createDataFrame(legs, schema)).collect()
    assert sorted((r.source_id, r.target_id) for r in got) == [(1, 10), (1, 11), (1, 12)]


def test_pruned_pairs_equal_all_pairs(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    rows = T.candidate_rows(v.transactions).where("id % 2 = 0").cache()
    a, b = rows.alias("a"), rows.alias("b")
    f = lambda t, c: F.col(f"{t}.{c}")
    before = (f("a", "date_posted") < f("b", "date_posted")) | ((f("a", "date_posted") == f("b", "date_posted")) & (f("a", "id") < f("b", "id")))
    cond = (f("a", "user_id") == f("b", "user_id")) & before & (F.datediff(f("b", "date_posted"), f("a", "date_posted")) <= 21) & (f("a", "account") != f("b", "account")) & (f("a", "transaction_type") != f("b", "transaction_type"))
    cols = ["id", "account", "currency", "transaction_type", "date_posted", "description", "words"]
    naive = a.join(b, cond).select(*[f(t, c).alias(f"{t}_{c}") for t in "ab" for c in cols], *[F.abs(S.money(f(t, "amount"))).alias(f"{t}_abs") for t in "ab"], *[S.fx_rate(f(t, "description")).alias(f"{t}_rate") for t in "ab"])
    want = naive.where(T.amount_score() > 0).select("a_id", "b_id").collect()
    assert sorted(map(tuple, want)) == sorted(map(tuple, T.pairs(rows).select("a_id", "b_id").collect()))


def test_graphs(spark):
    e = "user_id long, id long, source_transaction_id long, target_transaction_id long, status string, confidence_score double"
    rows = [(1, k, a, b, s, 0.9) for k, (a, b, s) in enumerate([(1, 2, "AUTO_APPROVED"), (2, 3, "USER_APPROVED"), (3, 4, "USER_REJECTED"), (10, 11, "AUTO_APPROVED"), (4, 5, "AUTO_APPROVED"), (5, 6, "AUTO_APPROVED")])]
    links = spark.createDataFrame(rows, e)
    got = {r.id: r.depth for r in G.walk(links, spark.createDataFrame([(1, 1)], "user_id long, id long")).collect()}
    assert got == {1: 0, 2: 1, 3: 2}
    ch = G.chains(links).collect()
    assert {(r.component, r.link_id, r.chain_position) for r in ch} == {(1, 0, 0), (1, 1, 1), (4, 4, 0), (4, 5, 1)}
    m = spark.createDataFrame([(1, 1, 1, 100, 0.8, "AUTO_APPROVED"), (1, 2, 3, 101, 0.9, "USER_APPROVED")], "user_id long, id long, transaction_id long, document_id long, confidence_score double, status string")
    assert [(r.id, r.depth, r.seed) for r in G.nearest_proof(links, m).collect()] == [(2, 1, 3)]
    closing = G.cycle_edges(links.where("status <> 'USER_REJECTED'"), spark.createDataFrame([(1, 1, 3), (1, 3, 4)], "user_id long, source_transaction_id long, target_transaction_id long")).collect()
    assert [(r.source_transaction_id, r.target_transaction_id) for r in closing] == [(1, 3)]


def test_statements_from_files(spark, tmp_path):
    (tmp_path / "usd_chequing.csv").write_text("# note\n\nAccount Number,Transaction Type,Date Posted,Transaction Amount,Description\n'1',DEBIT,20240105,-12.50,\"Shop, Inc\"\n1,CREDIT,20240106,\"1,000.00\",Pay\n1,DEBIT,bad,1,x\n")
    (tmp_path / "wise.csv").write_bytes("ID,Status,Direction,Created on,Finished on,Source amount,Source currency,Target amount,Target currency,Exchange rate,Fee,Reference\n1,COMPLETED,OUT,2024-02-01 10:00:00,,100,CAD,70,USD,0.7,1,Café\n2,CANCELLED,OUT,2024-02-01 10:00:00,,100,CAD,70,USD,0.7,1,r\n".encode("latin-1"))
    (tmp_path / "paypal.csv").write_text("Date,Time,TimeZone,Name,Type,Status,Currency,Gross,Fee,Net,Subject,Transaction ID\n13/02/2024,1,x,Ann,Sale,Completed,USD,-5.00,0,-5,Sub,1\n02/03/2024,1,x,,General Currency Conversion,Completed,USD,5.00,0,5,,2\n02/03/2024,1,x,Bob,Sale,Completed,CAD,0,0,0,,3\n")
    (tmp_path / "card.csv").write_text("transaction date,Posting Date,Description,Amount,Card Number\n01/02/2024,01/03/2024,Fuel,20.00,1\n01/02/2024,01/04/2024,Back,-5.00,1\n")
    got = sorted((r.account, r.transaction_type, r.date_posted, r.amount, r.currency, r.description) for r in statements.read(spark, str(tmp_path)).collect())
    assert got == [("CreditCard", "CREDIT", "2024-01-04", "-5.00", "CAD", "Back"), ("CreditCard", "DEBIT", "2024-01-03", "20.00", "CAD", "Fuel"), ("PayPal", "DEBIT", "2024-02-13", "-5.00", "USD", "Ann — Sub — Sale"),
                   ("USD", "CREDIT", "2024-01-06", "1000.00", "USD", "Pay"), ("USD", "DEBIT", "2024-01-05", "-12.50", "USD", "Shop, Inc"), ("Wise", "DEBIT", "2024-02-01", "-100.00", "CAD", "Café (CAD -> 70 USD @ 0.7)")]
    (tmp_path / "odd.csv").write_text("some prose\nmore\n")
    with pytest.raises(ValueError):
        statements.read(spark, str(tmp_path))


def test_statement_text_and_payloads(spark):
    card = "Jan 28 Jan 30 GROCER 12.34\nDec 30 Dec 31 HOTEL 1,200.00\nFeb 1 Feb 2 RETURN 5.00 CR\nnoise"
    df = spark.createDataFrame([("f", card, 2024, 2)], "file string, text string, year int, month int")
    assert sorted((r.date_posted, r.transaction_type, r.amount) for r in statements.card_text(df).collect()) == [("2023-12-31", "DEBIT", "1200.00"), ("2024-01-30", "DEBIT", "12.34"), ("2024-02-02", "CREDIT", "-5.00")]
    cheq = "Jan02 DEPOSIT A 100.00 1,100.00\nJan03 RENT 50.00 1,050.00\nJan04 PAY 10.00 1,060.00"
    df = spark.createDataFrame([("f", cheq, 2024, 1)], "file string, text string, year int, month int")
    assert [(r.date_posted, r.transaction_type, r.amount) for r in statements.chequing_text(df).orderBy("date_posted").collect()] == [("2024-01-02", "CREDIT", "100.00"), ("2024-01-03", "DEBIT", "-50.00"), ("2024-01-04", "CREDIT", "10.00")]
    js = '```json\n{"transactions": [{"date": "2024-01-02", "amt": "-5.00", "desc": "a"}, {"date_posted": "01/03/2024", "amount": "7", "type": "credit", "description": "b"}, {}]}\n```'
    got = statements.model_rows(spark.createDataFrame([("f", js)], "file string, json string")).orderBy("row").collect()
    assert [(r.date, r.amount, r.type, r.description) for r in got] == [("2024-01-02", "5.00", "DEBIT", "a"), ("2024-01-03", "7.00", "CREDIT", "b")]
    api = spark.createDataFrame([("1", "S", "T0006", "-3.00", "CAD", "2024-01-01T0", None, "ann@acme.com", None), ("2", "P", "T0006", "1", "CAD", "x", None, None, None), ("3", "S", "T1201", "4", "USD", "2024-01-02T0", "Bob", None, None), ("4", "S", "T0200", "4", "USD", "2024-01-02T0", "Bob", None, None)], "id string, status string, code string, amount string, currency string, at string, name string, email string, subject string")
    assert [(r.description, r.amount) for r in statements.api_rows(api).orderBy("date_posted").collect()] == [("Acme", "-3.00"), ("Bob", "4.00")]


def test_order_lines(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("Order ID,Order Date,Shipment Date,Product Name,Currency,Unit Price,Unit Price Tax,Quantity,Total Owed,Order Status\nA,2024-01-01,2024-01-02,Pen,CAD,10,1,2,22,Closed\nA,2024-01-01,2024-01-02,Ink,CAD,5,1,1,,Closed\nB,2024-01-01,2024-01-03,Cup,CAD,5,1,1,6,Cancelled\n")
    ship = orders.shipments(orders.order_lines(statements.table(spark, str(tmp_path)))).collect()
    assert [(r.order_id, r.amount, r.description) for r in ship] == [("A", "28.00", "Pen; Ink")]


def test_sinks(spark):
    rows = spark.createDataFrame([txn(1, "-5.00"), txn(2, "7.00", kind="CREDIT", ccy="USD")], TXN)
    with pytest.raises(sinks.MixedCurrencyError):
        sinks.qbo_csv(rows)
    assert [tuple(r) for r in sinks.qbo_csv(rows.where("currency = 'CAD'")).collect()] == [("03/10/2024", "x", "-5.00")]
    batch = spark.createDataFrame([txn(1, "-5.00"), txn(3, "1.00"), txn(3, "1.00")], TXN)
    assert [tuple(r) for r in sinks.insert_counts(rows, batch).collect()] == [("a.csv", 3, 1, 2)]
    up = sinks.upsert(spark.createDataFrame([(1, "a", 1)], "k int, v string, n int"), spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "k int, v string, n int"), ["k"], "n")
    assert sorted(map(tuple, up.collect())) == [(1, "b", 2), (2, "c", 1)]
    assert sinks.sheet_name("CreditCard", "x" * 40) == ("CreditCard " + "x" * 40)[:31]


def test_month_sync_and_streams(spark, tmp_path):
    cols = TXN + ", ym string"
    old = spark.createDataFrame([(*txn(1, "1.00", "2024-01-05"), "2024-01"), (*txn(2, "1.00", "2024-02-05"), "2024-02")], cols)
    batch = spark.createDataFrame([txn(3, "1.00", "2024-01-09"), txn(4, "1.00", "2024-02-09"), txn(4, "1.00", "2024-02-09"), txn(5, "1.00", "2023-12-01")], TXN)
    assert sorted(r.id for r in sync.merge_month(old, batch, "2024-02").collect()) == [1, 4, 5]
    src, target = tmp_path / "src", tmp_path / "out"
    batch.coalesce(1).write.parquet(str(src))
    q = sync.stream_months(spark, str(src), batch.schema, str(target), str(tmp_path / "c1"), "2024-02")
    q.awaitTermination(60)
    batch.where("id = 4").withColumn("id", F.lit(9).cast("long")).coalesce(1).write.mode("append").parquet(str(src))
    sync.stream_months(spark, str(src), batch.schema, str(target), str(tmp_path / "c1"), "2024-02").awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(target)).collect()) == [3, 5, 9]
    # a second tenant's file leaves the first one's months alone
    other = spark.createDataFrame([txn(21, "1.00", "2024-01-07"), txn(22, "1.00", "2024-02-07")], TXN).withColumn("user_id", F.lit(2).cast(batch.schema["user_id"].dataType))
    other.coalesce(1).write.mode("append").parquet(str(src))
    sync.stream_months(spark, str(src), batch.schema, str(target), str(tmp_path / "c1"), "2024-02").awaitTermination(60)
    assert sorted(r.id for r in spark.read.parquet(str(target)).collect()) == [3, 5, 9, 21, 22]
    assert sorted(r.id for r in sync.merge_month(old, other, "2024-02").collect()) == [1, 2, 21, 22]
    sync.stream_unique(spark, str(src), batch.schema, str(tmp_path / "u"), str(tmp_path / "c2")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "u")).count() == 5


def test_sequences_and_bands(spark):
    jobs = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "2024-01-01 00:10:00"), (1, 2, "2024-01-01 00:05:00", "2024-01-01 00:20:00"), (1, 3, "2024-01-01 00:30:00", None), (1, 4, "2024-01-01 09:00:00", None)], "user_id long, id long, created_at string, finished_at string")
    jobs = jobs.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "finished_at")})
    assert [(r.anchor, r.n, r.finished) for r in Q.batch_summary(jobs).orderBy("batch").collect()] == [(1, 2, 2), (3, 2, 0)]
    assert Q.latest_batch(jobs).first().anchor == 3
    rows = [(1.2, 0.0, 1.0, 0.5, "above"), (0.7, 0.2, 0.5, 0.9, "within"), (0.4, None, 0.5, None, "below"), (9.0, 0.2, 0.5, 0.9, "far_above"), (0.1, None, None, None, "no_data")]
    got = values(spark, rows, "r double, a double, m double, b double, s string", C.compare_ratio(F.col("r"), F.col("a"), F.col("m"), F.col("b")))
    assert [g[0] for g in got] == [r[4] for r in rows]
    out = C.honest_band(F.col("m"), F.col("v"))
    assert values(spark, [(2.0, [1.0, 2.0, 3.0]), (2.0, [1.0, 3.0, 2.0]), (9.0, [1.0, 2.0, 3.0])], "m double, v array<double>", out["q1"], out["q3"]) == [(1.0, 3.0), (None, None), (None, None)]


def test_currency_relabel_never_mixes_sums(spark):
    rows = [txn(i, f"{i}.00", ccy="CAD" if i % 2 else "USD", status="MATCHED", category="Rent") for i in range(1, 30)]
    links = spark.createDataFrame([], "user_id long, source_transaction_id long, target_transaction_id long, link_type string, status string")
    df = spark.createDataFrame(rows, TXN)
    got = {r.currency: r.expenses for r in R.category_breakdown(df, links).collect()}
    assert float(got["CAD"]) == sum(range(1, 30, 2)) and float(got["USD"]) == sum(range(2, 30, 2))
    assert R.category_breakdown(df.withColumn("status", F.lit("EXCLUDED")), links).count() == 0
    assert P.with_transfer(df, links.union(spark.createDataFrame([(1, 5, 6, "FX_CONVERSION", "PENDING_REVIEW")], links.schema))).where("is_transfer").count() == 2


def test_nearest_proof_starts_from_all_matches(spark):
    sf = "/root/testdata/sf0.001"
    v = Views(spark, sf)
    edges = collections.defaultdict(set)
    for r in v.chain_links.where(F.col("status") != "USER_REJECTED").collect():
        edges[r.source_transaction_id].add(r.target_transaction_id)
        edges[r.target_transaction_id].add(r.source_transaction_id)
    best = {}
    for r in v.matches.where(F.col("status").isin("AUTO_APPROVED", "USER_APPROVED")).collect():
        best[r.transaction_id] = min(best.get(r.transaction_id, (1, 0)), (-r.confidence_score, r.transaction_id))
    known, frontier, want = set(best), best, set()
    for depth in range(1, 21):
        step = {}
        for u, b in frontier.items():
            for w in edges[u] - known:
                step[w] = min(step.get(w, b), b)
        want |= {(w, depth, b[1]) for w, b in step.items()}
        known, frontier = known | set(step), step
    got = QUERIES["nearest_proof"](spark, sf).collect()
    assert {(r.id, r.depth, r.seed) for r in got} == want and len(got) == len(want) > 0


def test_spread_join_gives_the_rows_of_a_plain_join(spark):
    from ledgerloom.operators.spread import SPLIT, met

    left = spark.createDataFrame([(i % 3 if i % 7 else None, i if i % 5 else None) for i in range(60)] + [(9, 1), (0, 1), (0, 1)], "k int, a int")
    right = spark.createDataFrame([(k, b) for k in (0, 1, 1, None, 5) for b in range(4)], "k int, b int")
    rows = lambda df: sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())
    assert rows(met(left, right, ["k"], "a").select("k", "a", "b")) == rows(left.join(right, ["k"]).select("k", "a", "b"))
    assert met(left.limit(0), right, ["k"], "a").count() == 0 and SPLIT > 1
