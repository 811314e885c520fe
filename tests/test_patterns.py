"""Patterns, verdict bands, cached decisions and judged links on hand-made rows."""

import hashlib
import random

from pyspark.sql import functions as F

from ledgerloom.functions import tables as X
from ledgerloom.operators import categorise as C
from ledgerloom.operators import patterns as V
from ledgerloom.operators import predicates as P
from ledgerloom.operators import transfers as T
from ledgerloom.sources import uploads

RATIO = "user_id long, flag_key string, severity string, bucket string, amount double, your_pct double, weight double"


def facts_of(spark, rows):
    r = spark.createDataFrame(rows, "user_id long, category string, currency string, i string, e string").select("user_id", "category", "currency", F.col("i").cast("decimal(18,2)").alias("income"), F.col("e").cast("decimal(18,2)").alias("expenses"))
    rates = spark.createDataFrame([("CAD", "1"), ("USD", "2")], "currency string, r string").select("currency", F.col("r").cast("decimal(12,6)").alias("rate"))
    return V.facts(r, P.taxonomy(spark), rates)


def test_facts_and_patterns(spark):
    sales, sub, wages = "Sales of goods and services", "Purchases, materials and sub-contracts", "Labour and commissions"
    rows = [
        (1, sales, "CAD", "1000.00", "5.00"), (1, sub, "CAD", "0", "150.00"), (1, sub, "USD", "0", "75.00"), (1, wages, "CAD", "0", "100.00"), (1, "Travel", "CAD", "0", "60.00"), (1, "Internal transfer", "CAD", "0", "900.00"),
        (2, sales, "CAD", "100.00", "0"), (2, "Travel", "CAD", "0", "600.00"), (2, "no such", "CAD", "0", "500.00"), (2, "Other indirect expenses", "CAD", "0", "500.00"), (2, sales, "EUR", "9.00", "0"), (3, "Travel", "CAD", "0", "600.00"), (4, sales, "CAD", "100.00", "0"),
    ]
    facts = facts_of(spark, rows)
    got = {r.user_id: r for r in facts.collect()}
    assert (got[1].revenue, got[1].spent, got[1].by_bucket["subcontracts"], got[1].fragmented) == (1000.0, 460.0, 300.0, False)
    assert (got[2].revenue, got[2].spent, got[2].fragmented) == (100.0, 1600.0, True) and got[4].by_bucket == {}
    ratios = spark.createDataFrame([(1, "ratio_subcontracts_high", "stands_out", "subcontracts", 300.0, 0.3, 9.0), (1, "ratio_rent_high", "elevated", "rent", 1.0, 0.1, 4.0), (2, "ratio_travel_high", "stands_out", "travel", 600.0, 6.0, 20.0)], RATIO)
    flags = V.flags(facts, ratios)
    keys = {(r.user_id, r.flag_key): round(r.weight, 6) for r in flags.collect()}
    assert keys == {(1, "pattern_contractor_heavy"): 4.5, (1, "ratio_rent_high"): 4.0, (1, "pattern_travel_over_threshold"): 1.5, (2, "ratio_travel_high"): 20.0, (2, "pattern_expenses_exceed_revenue"): 12.0, (2, "pattern_category_fragmentation"): 3.0}
    dismissed = spark.createDataFrame([(1, "ratio_rent_high"), (1, "ratio_rent_high"), (2, "x")], "user_id long, flag_key string")
    band = {r.user_id: (r.band, r.shown, r.n_flags, r.n_dismissed) for r in V.verdict(facts, flags, dismissed).collect()}
    assert band == {1: ("a_few", "pattern_contractor_heavy,pattern_travel_over_threshold", 2, 1), 2: ("several", "ratio_travel_high,pattern_expenses_exceed_revenue,pattern_category_fragmentation", 3, 0), 4: ("typical", "", 0, 0)}


def test_generic_income_owner_draw_and_the_cap(spark):
    generic = [c for c, *_, operating, _, g in X.TAXONOMY if operating and g]
    tax = P.taxonomy(spark).unionByName(spark.createDataFrame([("Own", "equity", "", "distribution", None, False, False, 1.0, False), ("Any income", "income", "", "operating_revenue", None, False, True, 1.0, True)], P.taxonomy(spark).schema))
    r = spark.createDataFrame([(1, "Any income", "CAD", 90.0, 0.0), (1, "Own", "CAD", 10.0, 30.0), (1, "Sales of goods and services", "CAD", 10.0, 0.0)], "user_id long, category string, currency string, i double, e double").select("user_id", "category", "currency", F.col("i").cast("decimal(18,2)").alias("income"), F.col("e").cast("decimal(18,2)").alias("expenses"))
    rates = spark.createDataFrame([("CAD",)], "currency string").withColumn("rate", F.lit("1").cast("decimal(12,6)"))
    facts = V.facts(r, tax, rates)
    row = facts.first()
    assert (row.revenue, row.generic, row.drawn) == (100.0, 90.0, 20.0) and generic == []
    ratios = spark.createDataFrame([(1, f"ratio_{k}", "elevated", f"b{k}", 1.0, 0.1, float(10 - k)) for k in range(6)], RATIO)
    flags = V.flags(facts, ratios)
    assert {r.flag_key for r in flags.collect() if r.layer == "B"} == {"pattern_generic_income_bucket", "info_owners_draw_present"}
    out = V.verdict(facts, flags, ratios.select("user_id", "flag_key").limit(0)).first()
    assert (out.band, out.n_flags, len(out.shown.split(","))) == ("several", 8, 5)


def test_cached_decisions(spark):
    clusters = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.5), (1, "c", 0.0), (1, "d", 0.0), (2, "a", 0.0)], "user_id long, vendor_key string, proof_coverage double")
    cache = spark.createDataFrame([(1, "a", "Rent"), (1, "b", "Rent"), (1, "c", "gone"), (3, "a", "Rent")], "user_id long, vendor_key string, category string")
    got = {(r.user_id, r.vendor_key): (r.category, r.reused) for r in C.cached_decisions(clusters, cache).collect()}
    assert got == {(1, "a"): ("Rent", True), (1, "b"): (None, False), (1, "c"): (None, False), (1, "d"): (None, False), (2, "a"): (None, False)}


def loop_judged(verdicts, size, ccy):
    used, legs, claimed, out = set(), {}, {}, []
    for s, t, kind, f in sorted(verdicts, key=lambda v: (-v[3], v[0], v[1])):
        if f < 0.55 or t in used or t in legs or s in used or (s in legs and kind != "REFUND"):
            continue
        if kind == "REFUND":
            if s not in size or t not in size:
                continue
            if ccy[s] == ccy[t]:
                if claimed.get(s, 0) + size[t] > size[s] + 0.01:
                    continue
                claimed[s] = claimed.get(s, 0) + size[t]
            legs[s] = legs.get(s, 0) + 1
            place = legs[s] - 1
        else:
            used.add(s)
            place = 0
        used.add(t)
        out.append((s, t, kind, round(f * 0.95, 4), place))
    return sorted(out)


def test_judged_links_match_a_loop(spark):
    rng = random.Random(3)
    size, ccy = {i: float(rng.choice([10, 20, 30, 60]) if i > 7 else 60) for i in range(45)}, {i: rng.choice(["CAD", "USD"]) for i in range(45)}
    txns = spark.createDataFrame([(1, i, str(-v), ccy[i]) for i, v in size.items()], "user_id long, id long, amount string, currency string")
    verdicts = list({(s, t): (s, t, rng.choice(["REFUND", "REFUND", "INTERNAL_TRANSFER"]), rng.choice([0.5, 0.55, 0.6, 0.7, 0.8, 0.9])) for s, t in (rng.sample(range(50), 2) if k % 2 else (rng.randrange(8), rng.randrange(8, 50)) for k in range(200))}.values())
    df = spark.createDataFrame([(1, *v) for v in verdicts], "user_id long, source_id long, target_id long, link_type string, factor double")
    out = T.assign_judged(df, txns).collect()
    assert sorted((r.source_id, r.target_id, r.link_type, r.confidence, r.chain_position) for r in out) == loop_judged(verdicts, size, ccy)
    assert any(r.chain_position > 0 for r in out) and all((r.chain_id is None) == (r.link_type != "REFUND") for r in out)


def test_links_of_many_components_share_calls(spark):
    df = spark.range(4000).selectExpr("1L as user_id", "3 * id as source_id", "3 * id + 1 as target_id", "'INTERNAL_TRANSFER' as link_type", "0.8D as factor")
    txns = spark.range(12000).selectExpr("1L as user_id", "id", "'5.00' as amount", "'CAD' as currency")
    out = T.assign_judged(df.unionByName(df.selectExpr("user_id", "target_id as source_id", "target_id + 1 as target_id", "link_type", "0.7D as factor")), txns)
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    assert sorted((r.source_id, r.target_id) for r in out.collect()) == [(3 * k, 3 * k + 1) for k in range(4000)]


def test_link_picker(spark):
    row = lambda i, account, kind, amount, ccy, day, text, user=1: (user, i, account, kind, amount, ccy, day, text, None)
    rows = [
        row(1, "Wise", "DEBIT", "-100.00", "USD", "2024-03-10", "own"), row(2, "Wise", "CREDIT", "100.00", "USD", "2024-03-11", "same account"), row(3, "Wise", "CREDIT", "137.00", "CAD", "2024-03-10", "other currency"), row(4, "Wise", "DEBIT", "-5.00", "USD", "2024-03-10", "same type"),
        row(5, "CAD", "CREDIT", "135.00", "CAD", "2024-03-12", "transfer AT1.35"), row(6, "CAD", "CREDIT", "100.00", "CAD", "2024-03-12", "linked"), row(7, "CAD", "CREDIT", "100.00", "USD", "2020-01-01", "far"), row(8, "CAD", "CREDIT", "100.00", "USD", "2024-03-10", "foreign", user=2),
    ]
    t = spark.createDataFrame(rows, "user_id long, id long, account string, transaction_type string, amount string, currency string, date_posted string, description string, category string")
    links = spark.createDataFrame([(1, 6, 1, "PENDING_REVIEW"), (1, 1, 7, "USER_REJECTED"), (2, 1, 5, "AUTO_APPROVED")], "user_id long, source_transaction_id long, target_transaction_id long, status string")
    got = {r.id: r for r in T.link_picker(t, links, 1, 1).collect()}
    assert set(got) == {5, 7} and got[5].link_type == "FX_CONVERSION" and got[5].amount_score == 0.95
    found = T.link_picker(t, links, 1, 1, search=F.lit(True)).collect()
    assert {r.id: r.unavailable_reason for r in found} == {1: "self", 2: None, 3: None, 4: None, 5: None, 6: "already_linked", 7: None}
    assert {r.id: r.link_type for r in found if r.id in (2, 3, 4)} == {2: "REFUND", 3: "FX_CONVERSION", 4: "OTHER"}
    assert [r.unavailable_reason is None for r in found] == [True] * 5 + [False] * 2 and len(T.link_picker(t, links, 1, 1, search=F.lit(True), limit=2).collect()) == 2
    score = [r.confidence for r in found[:5]]
    assert score == sorted(score, reverse=True) and T.link_picker(t, links, 1, 99).count() == 0


def test_uploads_are_told_by_hash(spark, tmp_path):
    for name, body in (("a.pdf", b"1"), ("b.PNG", b"1"), ("c.jpeg", b"2"), ("d.csv", b"1"), ("e", b"3")):
        (tmp_path / name).write_bytes(body)
    up = uploads.files(spark, str(tmp_path)).withColumn("user_id", F.lit(1).cast("long"))
    h = {r.name: r.file_hash for r in up.collect()}
    assert h["c.jpeg"] == hashlib.sha256(b"2").hexdigest()
    seen = spark.createDataFrame([(1, h["c.jpeg"]), (1, h["c.jpeg"]), (2, h["a.pdf"])], "user_id long, file_hash string")
    assert {r.name: r.outcome for r in uploads.arrivals(up, seen).collect()} == {"a.pdf": "new", "b.PNG": "duplicate", "c.jpeg": "duplicate", "d.csv": "new", "e": "unsupported"}


def test_statements_without_a_job(spark):
    s = spark.createDataFrame([(1, 1, "processing"), (1, 2, "processing"), (1, 3, "done"), (2, 1, "processing")], "user_id long, id long, status string")
    j = spark.createDataFrame([(1, "statement", "queued", '{"statement_id": 1}'), (1, "receipt", "queued", '{"statement_id": 2}'), (1, "statement", "failed", '{"statement_id": 2}'), (1, "statement", "queued", "broken"), (1, "statement", "running", None)], "user_id long, kind string, status string, result string")
    assert sorted((r.user_id, r.id) for r in uploads.orphaned(s, j).collect()) == [(1, 2), (2, 1)]


def test_key_precedence(spark):
    rows = [(1, "AMZN Mktp CA", "Orchid Telecom", "k", "m"), (2, "AMZN Mktp CA", "", "k", "m"), (3, "#12", None, "k", "m"), (4, "#12", None, None, " M "), (5, "#Ab-12", None, "", None), (6, None, None, None, None)]
    df = spark.createDataFrame([(1, *r) for r in rows], "user_id long, id long, description string, proof_vendor string, stored_key string, model_key string")
    got = {r.id: (r.vendor_key, r.key_source) for r in C.cluster_keys(df).collect()}
    assert got[1] == ("orchid_telecom", "proof") and got[2][1] == "description" and got[3] == ("k", "stored") and got[4] == ("m", "model") and got[6] == ("unknown", "none") and got[5][1] in ("description", "slug")
