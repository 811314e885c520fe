"""Statements as text and tables, page batches, sheets, rails: rules against plain loops on hand-made rows."""

import collections
import datetime
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import rails
from ledgerloom.sources import statement_text as E


def pages_of(spark, rows):
    return spark.createDataFrame([(f, p, t, x) for f, p, t, x in rows], E.PAGES)


BANK = """Business Banking
For the period ending January 31, 2001
Nov30 Opening balance 100.00
Dec02 IncomingWirePayment, 20.00 120.00
Dec03 Card payment 5.00 115.00
Dec04 Note without balance 7.00
Dec05 Late deposit 10.00 125.00
Dec06 Closing totals 1.00 2.00
Jan02 Three amounts 3.00 4.00 118.00
Jan03 Overdraft fee 200.00 -82.00
Jan04 Same again 1.00 -82.00
Foo05 No month 1.00 -81.00
Jan05 Back 2.00 -80.00
"""


def test_type_follows_the_balance(spark):
    files = E.facts(pages_of(spark, [("a", 1, BANK, []), ("b", 1, "Opening balance\nFeb01 refund of fee 1.00 9.00\nFeb02 other 2.00 7.00\nFeb30 never 1.00 6.00", []), ("c", 1, "Feb01 no statement 1.00 2.00", []), ("d", 1, None, None)]), 1999)
    got = [(r.source_file, r.date_posted, r.transaction_type, r.amount, r.description) for r in E.balance_rows(files).orderBy("source_file", "source_row").collect()]
    assert got == [
        ("a", "2000-12-02", "CREDIT", "20.00", "IncomingWirePayment"), ("a", "2000-12-03", "DEBIT", "-5.00", "Card payment"), ("a", "2000-12-05", "CREDIT", "10.00", "Late deposit"), ("a", "2001-01-02", "DEBIT", "-3.00", "Three amounts"),
        ("a", "2001-01-03", "DEBIT", "-200.00", "Overdraft fee"), ("a", "2001-01-04", "DEBIT", "-1.00", "Same again"), ("a", "2001-01-05", "CREDIT", "2.00", "Back"),
        ("b", "1999-02-01", "CREDIT", "1.00", "refund of fee"), ("b", "1999-02-02", "DEBIT", "-2.00", "other"),
    ]


CARD = """Cashback World Mastercard
Statement date Jan. 28, 2000
Statement period Dec. 29, 1999 - Jan. 28, 2000
Dec. 30 Dec. 31 CEDARVIEW SUPPLIES ON 41.25
Jan. 13Jan. 13 TRSF FROM ACCOUNT 1,500.00 CR
Jan 14 Jan 15 Subtotal for card 9.00
January 15 January 16 LONG NAMES 2.00
"""


def test_card_lines_and_facts(spark):
    rows = [("card", 1, CARD, []), ("usd", 2, "US$Business account", []), ("usd", 1, "usd", []), ("w", 1, "PayPal\nActivity Statement 03/04/2001", []), ("w", 2, "05/13/2001 and 14/05/2001", []), ("x", 1, "paypal transaction history 14/05/2001 05/13/2001", []), ("y", 1, "PAYPAL merchant account id 01/02/2001", [])]
    files = E.facts(pages_of(spark, rows), 1999)
    got = {r.file: (r.account, r.is_wallet, r.date_order) for r in files.collect()}
    assert got == {"card": ("CreditCard", False, "dmy"), "usd": ("USD", False, "dmy"), "w": ("CAD", True, "mdy"), "x": ("CAD", True, "dmy"), "y": ("CAD", True, "dmy")}
    out = [(r.date_posted, r.transaction_type, r.amount, r.description) for r in E.card_rows(files).orderBy("source_row").collect()]
    assert out == [("1999-12-31", "DEBIT", "41.25", "CEDARVIEW SUPPLIES ON"), ("2000-01-13", "CREDIT", "-1500.00", "TRSF FROM ACCOUNT"), ("2000-01-16", "DEBIT", "2.00", "LONG NAMES")]


HEAD = ["Date", "Description", "Name / Email", "Gross", "Fee", "Net"]


def line(date, gross, said="Payment\nID: T1", name="Ann\na@b.c", fee="0.00"):
    return [date, said, name, gross, fee, None]


def test_section_currency_is_carried(spark):
    other = [["Date", "Total"], ["01/02/2001", "9"]]
    rows = [
        ("w", 1, "PayPal transaction history\n13/02/2001", [[HEAD, line("03/02/2001", "1.00")]]),
        ("w", 2, "Transaction History - USD\nx\nTransaction History - CAD", [other, [HEAD, line("04/02/2001", "-2.00")], [HEAD, line("05/02/2001", "3.00"), line("", "1"), line("2001-02-01", "1"), ["05/02/2001"]], [HEAD, line("06/02/2001", "4.00")]]),
        ("w", 3, "no header", [[HEAD, line("07/02/2001", "5.00")]]),
        ("w", 4, "Transaction History - USD", []),
        ("w", 5, None, [[HEAD, line("08/02/2001", "6.00", fee="-0.50"), line("09/02/2001", "7.00", said="General Currency Conversion"), line("31/02/2001", "8.00")], [HEAD]]),
        ("w", 6, "Transaction History - CAD\nTransaction History - USD", [[HEAD, line("10/02/2001", "9.00")]]),
        ("w", 7, "", [[HEAD, line("11/02/2001", "10.00")]]),
        ("v", 1, "PayPal transaction history 02/13/2001", [[HEAD, line("03/02/2001", "1.00")]]),
        ("n", 1, "PayPal transaction history", None),
    ]
    pages = pages_of(spark, rows)
    got = [(r.source_file, r.date_posted, r.currency, r.amount) for r in E.wallet_rows(pages, E.facts(pages)).orderBy("source_file", "source_row").collect()]
    day = lambda d: f"2001-02-{d:02d}"
    assert got == [("v", "2001-03-02", "CAD", "1.00"), ("w", day(3), "CAD", "1.00"), ("w", day(4), "USD", "-2.00"), ("w", day(5), "CAD", "3.00"), ("w", day(6), "CAD", "4.00"), ("w", day(7), "CAD", "5.00"), ("w", day(8), "USD", "6.00"), ("w", day(10), "CAD", "9.00"), ("w", day(11), "USD", "10.00")]
    assert [r.description for r in E.read(pages, 2001).where("amount = '6.00'").collect()] == ["Ann — Payment — fee -0.50"]


def test_reading_takes_the_first_reader_that_gives_rows(spark):
    table = [["Date", "Details", "Withdrawals", "Deposits", "Balance"], ["2001-01-02", "Tea", "4.00", "", "1"], ["Jan 3, 2001", "Pay", None, "1,000.00", "2"], ["", "x", "1", "", ""], ["04-Jan-2001", "-", "-", "", ""]]
    amount = [["Posting date", "What", "Amount"], ["01/05/01", "Cash", "-$7.00"], ["01/06/2001", "Back", "7.00"]]
    rows = [("t", 1, BANK, [table, [["a"]], amount]), ("l", 1, BANK, []), ("g", 1, "2001-02-01 Shop -3.00\n2001-02-02 Pay 4.00", []), ("c", 1, CARD, []), ("e", 1, "", [])]
    got = collections.defaultdict(list)
    for r in E.read(pages_of(spark, rows), 2001).orderBy("source_file", "source_row").collect():
        got[r.source_file].append((r.date_posted, r.amount, r.description))
    assert got["t"] == [("2001-01-02", "-4.00", "Tea"), ("2001-01-03", "1000.00", "Pay"), ("2001-01-05", "-7.00", "Cash"), ("2001-01-06", "7.00", "Back")]
    assert len(got["l"]) == 7 and [x[1] for x in got["g"]] == ["-3.00", "4.00"] and len(got["c"]) == 3 and "e" not in got


# payments over a rail

TXN = "user_id long, id long, date_posted string, amount string, description string"


def brute_anchors(days):
    """days in order of arrival -> anchor of each."""
    anchors, out = [], {}
    for d in days:
        if d not in out:
            near = [a for a in anchors if abs((d - a).days) <= 2]
            if not near:
                anchors.append(d)
            out[d] = near[0] if near else d
    return out


@pytest.mark.parametrize("ordered", [True, False])
def test_clusters_are_centred_on_their_first_member(spark, ordered):
    rng = random.Random(1)
    rows = [(u, k, datetime.date(2001, 1, 1) + datetime.timedelta(days=rng.randint(0, 60))) for u in (1, 2) for k in range(40)] + [(1, 99, None)]
    got = {(r.user_id, r.day): r.anchor for r in rails.anchors(spark.createDataFrame(rows, "user_id long, k long, day date"), order="k" if ordered else None).collect()}
    for u in (1, 2):
        own = [(k, d) for v, k, d in rows if v == u and d]
        want = brute_anchors([d for _, d in sorted(own)] if ordered else sorted(d for _, d in own))
        assert {d: a for (v, d), a in got.items() if v == u} == want


def brute_settle(assigned, pairs, txns, receipts):
    day = {i: datetime.date.fromisoformat(d) for _, i, d, _, _ in txns}
    size = {i: abs(float(a)) for _, i, _, a, _ in txns}
    rail = {i for _, i, _, _, x in txns if re.search("WISE PAYMENTS", x)}
    total = {i: float(t) for _, i, t in receipts}
    gap = {(t, d): g for _, t, d, g in pairs}
    now = {d: (t, "kept") for _, t, d, _ in assigned}
    held = {t for _, t, _, _ in assigned}
    asks = {}
    for _, t, d, g in assigned:
        offers = sorted((g2, t2) for (t2, d2), g2 in gap.items() if d2 == d and t2 not in held and g2 < g)
        if g > 30 and t in rail and offers:
            asks.setdefault(offers[0][1], []).append((offers[0][0], d))
    for t, ds in asks.items():
        now[min(ds)[1]] = (t, "moved closer")
    held = {t for t, _ in now.values()}
    anchor = brute_anchors(sorted(day[t] for t in held if t in rail))
    groups = collections.defaultdict(list)
    for d, (t, _) in now.items():
        if t in rail:
            groups[anchor[day[t]]].append(d)
    groups = {a: ds for a, ds in sorted(groups.items()) if len(ds) >= 2}
    extra = collections.defaultdict(list)
    for t in sorted(rail - held):
        fit = [a for a, ds in groups.items() if abs((day[t] - a).days) <= 2 and any((t, d) in gap for d in ds)]
        if fit:
            extra[fit[0]].append(t)
    out = {d: (t, None, o) for d, (t, o) in now.items()}
    for a, ds in groups.items():
        ds = sorted(ds, key=lambda d: (-total[d], d))
        ts = sorted([(-size[now[d][0]], 0, now[d][0]) for d in ds] + [(-size[t], 1, t) for t in extra[a]])
        new = [(t, d) for (_, _, t), d in zip(ts, ds, strict=False)]
        take = all(p in gap for p in new) and any(now[d][0] != t for t, d in new)
        for t, d in new:
            out[d] = (t if take else now[d][0], a, "reassigned" if take and t != now[d][0] else now[d][1])
    return {(d, *x) for d, x in out.items()}


def test_crossed_payments_are_ranked(spark):
    rng = random.Random(2)
    changed = collections.Counter()
    for seed in range(4):
        start = datetime.date(2001, 1, 1)
        txns = [(1, i, str(start + datetime.timedelta(days=rng.randint(0, 40))), str(-rng.choice([10, 20, 20, 30.5, 40])), rng.choice(["WISE PAYMENTS 1", "WISE PAYMENTS 2", "Shop"])) for i in range(40)]
        receipts = [(1, 100 + i, str(rng.choice([10, 20, 30.5, 40, 45]))) for i in range(24)]
        pairs = [(1, t[1], r[1], rng.choice([0, 3, 20, 31, 40, 44])) for t, r in itertools.product(txns, receipts) if rng.random() < (0.8 if seed else 0.3)]
        free = {t[1] for t in txns}
        assigned = []
        for r in receipts:
            own = [p for p in pairs if p[2] == r[1] and p[1] in free]
            if own and rng.random() < 0.8:
                assigned.append(rng.choice(own))
                free.discard(assigned[-1][1])
        p = spark.createDataFrame(pairs, "user_id long, transaction_id long, document_id long, gap int").withColumn("confidence", F.lit(0.5))
        out = rails.settle_crossed(spark.createDataFrame(assigned, "user_id long, transaction_id long, document_id long, gap int"), p, spark.createDataFrame(txns, TXN), spark.createDataFrame(receipts, "user_id long, id long, total string")).collect()
        assert {(r.document_id, r.transaction_id, r.anchor, r.outcome) for r in out} == brute_settle(assigned, pairs, txns, receipts) and len(out) == len(assigned)
        assert len({r.transaction_id for r in out}) == len(out)
        changed.update(r.outcome for r in out)
    assert changed["reassigned"] > 3 and changed["moved closer"] > 3
