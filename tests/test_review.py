"""Review aids on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import review as V


def test_pair_heuristics(spark):
    rows = [(100.0, 140.0, True, 0, "CAD|USD"), (100.0, 160.0, True, 0, "x"), (100.0, 130.0, False, 5, "CAD|USD"), (100.0, 160.0, False, 5, "x"), (100.0, 100.0, True, 22, "x")]
    df = spark.createDataFrame(rows, "a double, b double, s boolean, g int, p string").select(F.col("a").cast("decimal(18,2)").alias("a"), F.col("b").cast("decimal(18,2)").alias("b"), "s", "g", "p")
    got = df.select(V.plausible(F.col("a"), F.col("b"), F.col("s"), F.col("g")), V.amount_ratio(F.col("a"), F.col("b"), F.col("s")), V.heuristic_score(F.col("a"), F.col("b"), F.col("s"), F.col("g"), F.col("p"))).collect()
    assert [r[0] for r in got] == [True, False, True, False, False]
    assert got[2][1] == 0.7692 and got[0][1] is None
    assert got[0][2] == pytest.approx(0.5 * (1 - 40 / 140) + 0.3 + 0.2)


def test_validator_fallbacks(spark):
    df = spark.createDataFrame([("monthly fee", None, "CAD"), ("WISE x", None, "CAD"), ("shop", None, "CreditCard"), ("shop", "Cloud Co", "CAD"), ("shop", None, "CAD")], "d string, v string, a string")
    assert [r[0] for r in df.select(V.acceptable_days(F.col("d"), F.col("v"), F.col("a"))).collect()] == [45, 10, 7, 45, 14]
    df = spark.createDataFrame([("wire out", 100.0, 120.0), ("cafe", 100.0, 120.0), ("shop", 100.0, 110.0), ("shop", 100.0, 150.0)], "d string, t double, x double")
    assert [r[0] for r in df.select(V.acceptable_difference(F.col("d"), F.col("t"), F.col("x"))).collect()] == [25.0, 25.0, 15.0, 2.0]


def test_field_grades(spark):
    df = spark.createDataFrame([({"vendor": "Acme", "date": "2024-01-05", "total": "5", "currency": "CAD"},), ({"vendor": "", "date": "Jan 5", "total": "0", "currency": "XYZ"},)], "m map<string,string>")
    got = df.select(V.field_confidence(F.col("m")).alias("g")).withColumn("r", V.needs_review(F.col("g"))).collect()
    assert got[0].g == {"vendor": "high", "date": "high", "total": "high", "currency": "high"} and not got[0].r
    assert got[1].g == {"vendor": "low", "date": "medium", "total": "low", "currency": "medium"} and got[1].r


def test_ground_truth(spark):
    d = lambda k: dt.date(2024, 1, k)
    schema = "id long, account string, date date, amount double"
    parsed = spark.createDataFrame([(1, "A", d(1), 5.0), (2, "A", d(1), 5.0), (3, "A", d(9), 7.0), (4, "B", d(3), 9.0), (5, "A", d(20), 1.0)], schema)
    truth = spark.createDataFrame([(11, "A", d(1), 5.0), (12, "A", d(3), 5.0), (13, "A", d(7), 7.0), (14, "A", d(3), 9.0), (15, "A", d(28), 1.0)], schema)
    found = V.compare_to_truth(parsed, truth)
    assert sorted(map(tuple, found.collect())) == [(1, 11, 1), (2, 12, 2), (3, 13, 2), (4, 14, 3)]
    assert V.match_report(parsed, truth, found).first().rate == pytest.approx(0.8)


def test_decisions_and_cube(spark):
    m = spark.createDataFrame([(1, "PENDING_REVIEW", 0.86), (2, "PENDING_REVIEW", 0.84), (3, "USER_REJECTED", 0.99)], "id long, status string, confidence_score double")
    assert [r.status for r in V.bulk_approve(m, 0.5).orderBy("id").collect()] == ["USER_APPROVED", "PENDING_REVIEW", "USER_REJECTED"]
    links = spark.createDataFrame([(1, k, "AUTO_APPROVED") for k in range(4)], "user_id long, id long, status string")
    chains = spark.createDataFrame([(1, 0, "c"), (1, 1, "c"), (1, 2, "d")], "user_id long, link_id long, chain_id string")
    out = V.reject_links(links, links.where("id = 0").select("user_id", "id"), chains).orderBy("id").collect()
    assert [r.status == "USER_REJECTED" for r in out] == [True, True, False, False]
    with pytest.raises(ValueError):
        V.link_group(1, 5, [6, 6], "REFUND", spark)
    assert V.link_group(1, 5, [6, 7], "REFUND", spark).count() == 2
    st = spark.createDataFrame([(1, 1, "PROCESSING"), (1, 2, "PROCESSING"), (1, 3, "READY")], "user_id long, id long, status string")
    jobs = spark.createDataFrame([(1, "running", '{"statement_id": 1}'), (1, "done", '{"statement_id": 2}')], "user_id long, status string, result string")
    assert [r.id for r in V.orphaned_statements(st, jobs).collect()] == [2]
    log = spark.createDataFrame([(1, "A", "match", "2024-01-05 10:00:00"), (2, "B", "match", "2024-01-06 00:00:00")], "id long, action string, entity_type string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert [r.id for r in V.audit_view(log, end="2024-01-05").collect()] == [1]
    assert [r[0] for r in spark.createDataFrame([("1,200",), ("x",), ("5.5%",)], "t string").select(V.suppressed("t")).collect()] == [1200.0, None, 5.5]
    rows = spark.createDataFrame([("54", "CA", 1, 1.0), ("54", "CA", 3, 2.0), ("55", "CA", 2, 3.0)], "naics string, geo string, incorporation int, v double")
    assert sorted(r.v for r in V.preferred_rows(rows, [3, 2, 1]).collect()) == [2.0, 3.0]
    cells = spark.createDataFrame([("54", "rent", 120.0, 1.0, 2.0, 3.0), ("54", "x", 5.0, 3.0, 2.0, 4.0)], "naics string, bucket string, pct double, q1 double, median double, q3 double")
    assert sorted((r.bucket, r.error) for r in V.cube_errors(cells).collect()) == [("rent", "range"), ("x", "order")]


def test_document_relevance(spark):
    bill = "Invoice # 12 from: Acme Inc\nDate 2024-01-05 due date 2024-02-05\nsoftware hosting subscription\nSubtotal $10.00 GST $0.50 Total due $10.50 " + "x" * 120
    rows = [(1, bill, "a.pdf"), (2, "hello", "b.pdf"), (3, bill + " coffee", "c.pdf"), (4, bill, "non-financial.pdf"), (5, None, None)]
    got = {r.id: r for r in V.relevance(spark.createDataFrame(rows, "id int, text string, filename string")).collect()}
    assert got[1].included and got[1].monetary_amount == 1.0 and got[1].transaction_date == 1.0 and got[1].business_relevance == 1.0
    assert [got[k].reason for k in (2, 3, 4, 5)] == ["no_amount", "personal", "non_financial", "no_amount"]
