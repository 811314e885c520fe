"""Queries over the ledger views: one function for each key, with its SQL twin in `oracles`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X
from ..operators import categorise as C
from ..operators import cube as B
from ..operators import linkage as L
from ..operators import linked as G
from ..operators import lookup as U
from ..operators import overview as O
from ..operators import patterns as V
from ..operators import pages as D
from ..operators import predicates as P
from ..operators import quotes as H
from ..operators import rails as W
from ..operators import reporting as R
from ..operators import sequences as Q
from ..operators import transfers as T
from ..sources import orders as Z
from ..sources import sheets as J
from ..sources import sinks as K
from ..sources import statement_text as E
from ..sources import statements as Y
from ..sources import uploads
from ..operators.cut import written
from ..streaming import actions as A
from .views import Views

RATES = [("CAD", "1.000000"), ("USD", "1.370000")]
QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir, fn=fn: fn(Views(spark, sf_dir))
    return fn


def _rates(v: Views) -> DataFrame:
    return v.spark.createDataFrame(RATES, "currency string, rate string").select("currency", F.col("rate").cast("decimal(12,6)").alias("rate"))


@query
def category_breakdown(v):
    return R.category_breakdown(v.transactions, v.links)


@query
def category_breakdown_range(v):
    return R.category_breakdown(v.transactions, v.links, "1996-01-01", "1996-12-31")


@query
def monthly_trend(v):
    return R.monthly_trend(v.transactions, v.links)


@query
def period_financials(v):
    return R.period_financials(v.transactions, v.links, "1997-03")


@query
def current_previous_ytd(v):
    return R.current_previous_ytd(v.transactions, v.links, "1998-05", "1998-04")


@query
def dashboard_kpi(v):
    return R.dashboard_kpi(v.transactions, v.matches, v.links)


@query
def monthly_status_grid(v):
    return R.monthly_status(v.transactions, v.matches, v.links, 1999)


@query
def year_index(v):
    return R.year_index(v.transactions, v.matches, v.links)


@query
def tax_summary(v):
    return R.tax_summary(v.receipts)


@query
def doc_tax_by_txn(v):
    return R.doc_tax_by_transaction(v.matches, v.receipts)


@query
def category_pnl_rollup(v):
    return R.category_pnl(v.transactions, v.links, P.taxonomy(v.spark))


@query
def category_share_and_previous(v):
    return R.share_and_previous(v.transactions, v.links, P.taxonomy(v.spark), "1998-05", "1998-04")


@query
def to_cad_totals(v):
    totals = R._money_rows(v.transactions, v.links).groupBy("user_id", "currency").agg(*R.flows())
    return R.in_base_currency(totals, _rates(v))


@query
def account_month_report(v):
    return R.account_month(v.transactions, v.links, "1997-07")


@query
def status_counts_dense(v):
    return R.dense_counts(v.transactions, "status", ["UNMATCHED", "MATCHED", "IGNORED", "EXCLUDED", "PENDING", "LINKED"])


@query
def job_counts_by_kind(v):
    return R.dense_counts(v.jobs.where("status = 'pending'"), "kind", ["receipt", "statement"])


@query
def date_range(v):
    return v.transactions.groupBy("user_id").agg(F.min("date_posted").alias("first_date"), F.max("date_posted").alias("last_date"), F.max(S.month("date_posted")).alias("latest_month"))


@query
def grid_page(v):
    rows = U.grid(P.tenant(v.transactions, 1), status="UNMATCHED", month="1997", least="1000.00")
    return U.page(rows, 3, 50, "amount").select("id", "date_posted", S.money("amount").alias("amount"), "status")


@query
def row_page_number(v):
    return U.page_of_row(v.transactions, 50)


@query
def recent_transactions(v):
    return U.top_recent(v.transactions, 25).select("user_id", "id", "date_posted", "place")


@query
def txn_search(v):
    return v.transactions.where(U.transaction_search("orchid")).select("user_id", "id", "description")


@query
def txn_search_amount(v):
    return v.transactions.where(U.transaction_search("#4242")).select("user_id", "id", "description")


@query
def doc_search_fuzzy(v):
    return v.receipts.where(U.document_search("bluepek")).select("user_id", "id", "vendor")


@query
def linkable_pool(v):
    return U.linkable(v.transactions, v.links).select("user_id", "id", "date_posted", "status")


@query
def linked_ids(v):
    return U.linked_ids(v.links)


@query
def unmatched_docs_distinct(v):
    return U.unmatched_documents(v.receipts, v.matches).select("user_id", "id", "file_hash")


@query
def matches_with_both_sides(v):
    return G.matches_with_sides(v.matches, v.transactions, v.receipts).select("user_id", "id", "status", "description", "amount", "vendor", "total")


@query
def document_list_with_txns(v):
    return G.documents_with_transactions(v.receipts, v.matches)


@query
def links_both_directions(v):
    return G.both_directions(v.links, v.transactions)


@query
def unified_proof(v):
    return G.unified_proof(v.matches, v.receipts, v.links, v.transactions)


@query
def proof_coverage(v):
    return G.proof_coverage(v.transactions, v.matches, v.receipts)


@query
def stored_coverage(v):
    return G.stored_coverage(v.matches)


@query
def link_offset(v):
    return G.link_offset(v.links, v.transactions)


@query
def available_docs_with_counts(v):
    return G.documents_with_counts(v.receipts, v.matches)


@query
def document_twins(v):
    return G.document_twins(v.receipts)


@query
def rejected_pairs_expanded(v):
    return G.rejected_pairs(v.matches, v.receipts)


@query
def binder_tally(v):
    return R.binder_tally(v.transactions, v.matches, v.receipts, v.links)


@query
def net_income_by_sheet(v):
    return R.net_income_by_sheet(v.transactions)


@query
def bucket_rollup(v):
    return R.bucket_rollup(v.transactions, v.links, P.taxonomy(v.spark), _rates(v))


@query
def heaviest_source_file(v):
    return R.heaviest_file(v.transactions, "Wise", "1996-01-01", "1997-12-31")


@query
def checklist_state(v):
    return R.checklist(v.transactions, v.receipts, v.matches, v.links)


@query
def rule_categories(v):
    return C.rule_categories(v.transactions)


@query
def vendor_key(v):
    return v.transactions.select("user_id", "id", S.vendor_key("description").alias("vendor_key"))


@query
def vendor_clusters(v):
    return C.vendor_clusters(v.transactions)


@query
def category_buckets(v):
    return v.transactions.select("user_id", "id", C.bucket(F.col("category")).alias("bucket"))


@query
def tax_codes(v):
    return C.tax_codes(v.transactions, R.doc_tax_by_transaction(v.matches, v.receipts), P.taxonomy(v.spark))


@query
def resolved_currency(v):
    money = lambda c: S.guarded_money(F.coalesce(c, F.lit("")))
    signal = S.tax_signal(money("tax_gst"), money("tax_hst"), F.lit(0), S.guarded_money("total"))
    out = S.resolved_currency(F.col("currency"), F.col("currency_source"), signal)
    return v.receipts.select("user_id", "id", out.getField("currency").alias("resolved"), out.getField("source").alias("resolved_source"))


@query
def receipt_candidates(v):
    return L.candidates(v.transactions, v.receipts, G.rejected_pairs(v.matches, v.receipts)).select("user_id", "transaction_id", "document_id", "match_reason", "gap")


@query
def amount_verdict(v):
    pairs = L.candidates(v.transactions, v.receipts)
    out = L.compare_amounts(F.col("txn_abs"), F.col("currency"), F.col("doc_abs"), F.col("doc_ccy"))
    return pairs.select("user_id", "transaction_id", "document_id", out.getField("verdict").alias("verdict"), out.getField("score").alias("score"))


@query
def pair_scores(v):
    pairs = L.scored(L.candidates(v.transactions, v.receipts))
    return pairs.select("user_id", "transaction_id", "document_id", "amount_score", "date_score", F.round("vendor_score", 9).alias("vendor_score"), F.round("confidence", 9).alias("confidence"))


@query
def receipt_assignment(v):
    out = L.classified(L.assigned(v.transactions, v.receipts))
    return out.select("user_id", "transaction_id", "document_id", "round", "decision", "stored_status", "label", "reasons")


@query
def receipt_first_round(v):
    out = L.assigned(v.transactions, v.receipts, rounds=1, vendor=0.5)
    return out.select("user_id", "transaction_id", "document_id")


@query
def match_explanations(v):
    return L.explained(L.scored(L.candidates(v.transactions, v.receipts))).select("user_id", "transaction_id", "document_id", "label", "flags", "summary")


@query
def unmatched_diagnosis(v):
    taken = L.assigned(v.transactions, v.receipts)
    return L.unmatched_diagnosis(v.transactions, L.best_documents(v.transactions, v.receipts, taken), taken)


def _transfer_pairs(v):
    return T.scored(T.pairs(T.candidate_rows(v.transactions)))


@query
def transfer_pairs_scored(v):
    return _transfer_pairs(v).select("user_id", "source_id", "target_id", "link_type", "amount_score", "date_score", "keyword_score", "account_score", F.round("score", 9).alias("score"), "status")


@query
def transfer_assignment(v):
    return T.assign(_transfer_pairs(v))


@query
def transfer_chains(v):
    return G.chains(v.chain_links)


@query
def link_walk(v):
    seeds = v.transactions.select(F.lit(0).cast("long").alias("user_id"), "id")
    return G.walk(v.chain_links, seeds).select("seed", "id", "depth")


@query
def link_components(v):
    ok = v.chain_links.where(P.active())
    return G.components(ok.select("user_id", F.col("source_transaction_id").alias("u"), F.col("target_transaction_id").alias("v")))


@query
def nearest_proof(v):
    m = v.matches.withColumn("user_id", F.lit(0).cast("long"))
    return G.nearest_proof(v.chain_links, m)


@query
def derived_status(v):
    return G.derived_status(v.transactions, v.matches, v.links)


@query
def status_repair(v):
    return G.status_repair(v.transactions, v.matches, v.links)


@query
def running_balance(v):
    return Q.running_balance(Q.statement_rows(v.transactions))


@query
def statement_balance_check(v):
    return Q.statement_check(Q.statement_rows(v.transactions))


@query
def first_of_duplicates(v):
    return Q.first_of_duplicates(Q.statement_rows(v.transactions)).select("user_id", "source_file", "id")


def _finished(v):
    end = F.when(F.col("status") != "pending", F.timestamp_seconds(F.unix_timestamp("created_at") + F.floor("seconds").cast("long")))
    return v.jobs.withColumn("finished_at", end)


@query
def job_batches(v):
    return Q.batch_summary(_finished(v))


@query
def queue_ahead(v):
    return Q.queue_ahead(v.jobs)


@query
def job_eta(v):
    return Q.eta(v.jobs).select("user_id", "pending", F.round("eta_seconds", 4).alias("eta_seconds"))


@query
def insert_counts(v):
    """The whole table arrives, credits twice, where settled rows are there already."""
    t = v.transactions
    return K.insert_counts(t.where("status = 'MATCHED'"), t.unionByName(t.where("transaction_type = 'CREDIT'")))


@query
def transfers_sheet(v):
    return K.transfers_sheet(v.links, v.transactions)


@query
def ledger_export(v):
    proofs = v.matches.where(P.proves()).join(v.receipts.select("user_id", F.col("id").alias("document_id"), "original_filename"), ["user_id", "document_id"]).groupBy("user_id", F.col("transaction_id").alias("id")).agg(F.min("original_filename").alias("file"))
    return K.ledger_csv(v.transactions, proofs, P.taxonomy(v.spark), U.linked_ids(v.links))


@query
def shipment_groups(v):
    """Order lines grouped into shipments, over the order tables."""
    lines = v.table("lineitem").select(F.col("l_orderkey").alias("order_id"), F.to_date("l_shipdate").alias("ship_date"), F.col("l_extendedprice").cast(S.MONEY).alias("total"), (F.col("l_extendedprice").cast(S.MONEY) * F.col("l_tax").cast("decimal(4,2)")).cast(S.MONEY).alias("tax"))
    return lines.groupBy("order_id", "ship_date").agg(F.sum("total").cast(S.MONEY).alias("total"), F.sum("tax").cast(S.MONEY).alias("tax"), F.count("*").alias("items"))


@query
def peer_comparison(v):
    amounts = R.bucket_rollup(v.transactions, v.links, P.taxonomy(v.spark), _rates(v))
    income = R._money_rows(v.transactions, v.links).where("transaction_type = 'CREDIT'").join(F.broadcast(_rates(v)), "currency")
    revenue = income.groupBy("user_id").agg(F.sum((F.col("value") * F.col("rate")).cast("decimal(24,6)")).cast(S.MONEY).alias("revenue"))
    cube = v.spark.createDataFrame([("54", "all", "all", b, q1, m, q3, 100) for b, q1, m, q3 in (("travel", 0.01, 0.05, 0.10), ("rent", 0.02, 0.06, 0.12), ("insurance", 0.20, 0.30, 0.40), ("office_supplies", 0.01, 0.01, 0.01))], "naics string, band string, cohort string, bucket string, q1 double, median double, q3 double, businesses int")
    wanted = revenue.select("user_id", F.lit("5415").alias("naics"), C.revenue_band(F.col("revenue")).alias("band"))
    return C.peer_lines(amounts, revenue, C.pick_cell(wanted, cube)).select("user_id", "bucket", F.round("ratio", 9).alias("ratio"), "status", "weight", "rank")


def _priced(v):
    """Receipts of which a tenth prints a second amount, in the payload."""
    second = (S.money("total").cast("decimal(14,2)") * F.lit("1.37").cast("decimal(3,2)")).cast("decimal(14,2)")
    return v.receipts.withColumn("raw_json", F.when(F.col("id") % 10 == 3, F.concat(F.lit('{"amount": "'), second.cast("string"), F.lit('"}'))))


@query
def receipt_candidates_alternate(v):
    return L.candidates(v.transactions, _priced(v)).select("user_id", "transaction_id", "document_id", "match_reason", "gap")


@query
def amount_scores_alternate(v):
    return L.scored(L.candidates(v.transactions, _priced(v))).select("user_id", "transaction_id", "document_id", "amount_score")


@query
def unambiguous_settled(v):
    pairs = L.scored(L.close_pairs(v.transactions, v.receipts))
    return L.unambiguous(v.transactions, v.receipts, pairs).select("user_id", "transaction_id", "document_id")


@query
def month_summary(v):
    return O.month_summary(v.transactions)


@query
def missing_proofs(v):
    return O.missing_proofs(v.transactions, v.matches, v.receipts, v.receipts.where("id % 3 <> 0"))


@query
def source_files_by_prefix(v):
    return O.source_files(v.transactions, "stmt_")


@query
def action_items(v):
    return O.action_items(v.transactions, v.matches)


@query
def setup_completeness(v):
    profiles = v.table("customer").where("c_custkey < 4").select(F.col("c_custkey").cast("long").alias("user_id"), F.col("c_name").alias("company_name"))
    return O.setup_completeness(profiles, v.transactions, v.receipts, v.jobs.where("kind = 'statement' and status = 'failed'"))


@query
def run_result(v):
    outcome = F.when(F.col("status") == "AUTO_APPROVED", "stored").when(F.col("status") == "USER_APPROVED", "refreshed").when(F.col("status") == "PENDING_REVIEW", "flagged").otherwise("displaced")
    return O.run_result(v.matches.select("user_id", outcome.alias("outcome")), v.transactions)


@query
def cost_summary(v):
    """Events as calls: the type is the endpoint, the value the cost."""
    calls = v.table("events").select((F.col("user_id") % 4).alias("user_id"), F.col("event_type").alias("endpoint"), F.when(F.col("event_id") % 3 == 0, "small").otherwise("large").alias("model"), F.col("value").alias("estimated_cost"), (F.col("event_id") % 1000).alias("tokens_in"), (F.col("event_id") % 77).alias("tokens_out"), F.col("ts").alias("created_at"))
    return O.cost_summary(calls, "1990-01-01", "2100-01-01")


@query
def job_list(v):
    return O.job_list(_finished(v))


@query
def first_and_latest_by_hash(v):
    return O.by_hash(v.receipts, F.col("id"))


@query
def matched_file(v):
    return O.matched_file(v.matches, v.receipts)


@query
def linked_or_found_ids(v):
    return O.linked_or_found(v.links, v.chain_links)


@query
def deleted_partners(v):
    return O.partners(v.links, v.transactions.where("status = 'EXCLUDED'"))


@query
def link_explanations(v):
    return O.link_explanations(v.links, v.transactions)


@query
def statement_rows_kept(v):
    return v.transactions.where(~P.summary_line()).select("user_id", "id")


@query
def vendor_rule_category(v):
    rules = [("telecom", "Utilities and telephone/telecommunication", 5), ("amzn|amazon", "Office supplies", 9), ("software", "Software and IT", 1)]
    out = P.priority_category(rules, "description", "account")
    return v.transactions.select("user_id", "id", out.getField("category").alias("rule_category"), out.getField("source").alias("rule_source"))


@query
def naics_resolution(v):
    spend = R.bucket_rollup(v.transactions, v.links, P.taxonomy(v.spark), _rates(v))
    profiles = v.transactions.select("user_id").distinct().select("user_id", F.when(F.col("user_id") == 1, "2382").alias("naics_code"), F.when(F.col("user_id") == 2, "Food & Hospitality").alias("industry_label"))
    return C.resolved_naics(profiles, spend)


@query
def profitability_lines(v):
    amounts = R.bucket_rollup(v.transactions, v.links, P.taxonomy(v.spark), _rates(v))
    income = R._money_rows(v.transactions, v.links).where("transaction_type = 'CREDIT'").join(F.broadcast(_rates(v)), "currency")
    revenue = income.groupBy("user_id").agg(F.sum((F.col("value") * F.col("rate")).cast("decimal(24,6)")).cast(S.MONEY).alias("revenue"))
    best = v.spark.createDataFrame([("travel", 0.04, 100), ("rent", 0.07, 100), ("insurance", None, 100)], "bucket string, pct double, businesses int")
    cells = revenue.select("user_id").crossJoin(F.broadcast(best))
    out = C.profitability_lines(amounts, revenue, cells)
    return out.select("user_id", "bucket", F.round("your_pct", 9).alias("your_pct"), "peer_pct", "rank")


def _rail_debits(v):
    """Open rows of which every third pays over a rail."""
    text = F.when(F.col("id") % 3 == 2, F.lit("WISE PAYMENTS 884120")).otherwise(F.col("description"))
    return v.transactions.withColumn("description", text)


@query
def crossed_payments(v):
    """The first round of the assignment, with the ties of rail payments put right."""
    t = _rail_debits(v)
    open_rows = t.where((F.col("status") == "UNMATCHED") & P.is_expense())
    first = L.assigned(t, v.receipts, rounds=1, amount=L.total_amount_of, vendor=0.5)
    out = W.settle_crossed(first, L.among(t, v.receipts, L.total_amount_of, 0.5), open_rows, v.receipts)
    return out.select("user_id", "transaction_id", "document_id", F.date_format("anchor", "yyyy-MM-dd").alias("anchor"), "outcome")


def _dated_receipts(v):
    """Rows and receipts of twenty-five years later, some receipts with a printed payment date, some in files named after a month."""
    later = lambda c: F.date_format(F.add_months(F.to_date(c), 300), "yyyy-MM-dd")
    t = v.transactions.withColumn("date_posted", later("date_posted"))
    r = v.receipts.withColumn("document_date", later("document_date"))
    day, k = F.to_date("document_date"), F.col("id") % 10
    paid = F.when(k == 1, F.concat(F.lit("Bank account on "), F.date_format(F.date_add(day, 9), "MMMM dd, yyyy"))).when(k == 2, F.concat(F.lit("visa "), F.date_format(F.date_add(day, 12), "yyyy-MM-dd")))
    named = F.when(k == 3, F.concat(F.lit("bill "), F.date_format(F.add_months(day, (F.col("id") % 4).cast("int")), "MMMyyyy"))).otherwise(F.col("original_filename"))
    raw = F.when(k == 4, F.concat(F.lit('{"payment_date": "'), F.date_format(F.date_add(day, 20), "yyyy-MM-dd"), F.lit('"}')))
    return t, r.withColumn("payment_method", paid).withColumn("original_filename", named).withColumn("raw_json", raw)


@query
def best_dates(v):
    r = _dated_receipts(v)[1]
    return r.select("user_id", "id", F.date_format(S.best_date("raw_json", "payment_method", "document_date", "original_filename"), "yyyy-MM-dd").alias("best"))


@query
def receipt_candidates_by_best_date(v):
    return L.candidates(*_dated_receipts(v)).select("user_id", "transaction_id", "document_id", "match_reason", "gap")


def _texts(lines):
    whole = lines.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("row", "line"))).alias("x"))
    return whole.select("file", F.lit(1).alias("page"), F.array_join(F.transform("x", lambda x: x["line"]), "\n").alias("text"), F.array().cast("array<array<array<string>>>").alias("tables"))


@query
def balance_typed_rows(v):
    return E.balance_rows(E.facts(_texts(v.statement_lines))).select("source_file", "source_row", "date_posted", "transaction_type", "amount", "description")


def _wallet_pages(v):
    """Pages of a wallet's statements: section headers as text, a table for each parity of the key."""
    cells = lambda *c: F.array(*[F.col(x) if x in ("date", "gross", "desc") else F.lit(x) for x in c])
    rows = v.wallet_lines.withColumn("date", F.concat_ws("/", "dd", "yyyy")).withColumn("desc", F.concat("said", F.lit("\nID: T"), F.col("id").cast("string")))
    tables = rows.groupBy("file", "page", "heads", "n").agg(F.array_sort(F.collect_list(F.struct("id", cells("date", "desc", "Someone", "gross", "0.00").alias("cells")))).alias("t"))
    head = F.array(*map(F.lit, ("Date", "Description", "Name / Email", "Gross", "Fee")))
    tables = tables.select("file", "page", "heads", "n", F.concat(F.array(head), F.transform("t", lambda x: x["cells"])).alias("t"))
    pages = tables.groupBy("file", "page", "heads").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("t"))
    marks = F.transform(F.filter(F.split("heads", ","), lambda x: x != ""), lambda x: F.concat(F.lit("Transaction History - "), x))
    dates = F.flatten(F.transform("t", lambda t: F.transform(F.slice(t["t"], F.lit(2), F.size(t["t"])), lambda r: r[0])))
    return pages.select("file", "page", F.array_join(F.concat(F.array(F.lit("PayPal activity statement")), marks, dates), "\n").alias("text"), F.transform("t", lambda t: t["t"]).alias("tables"))


@query
def wallet_page_rows(v):
    pages = _wallet_pages(v)
    return E.wallet_rows(pages, E.facts(pages)).select("source_file", "source_row", "date_posted", "transaction_type", "amount", "currency", "description")


@query
def statement_facts(v):
    """What each statement file says of itself, banks and wallets."""
    return E.facts(_texts(v.statement_lines).unionByName(_wallet_pages(v)), 2000).select("file", *E.FACTS)


def _peer_facts(v):
    """Facts of tenants of a few rows each: customers."""
    rows = v.customer_transactions.where("status <> 'EXCLUDED'").groupBy("user_id", F.coalesce("category", F.lit("Uncategorized")).alias("category"), "currency").agg(*R.flows_of(P.absolute()))
    return written(V.facts(rows, P.taxonomy(v.spark), _rates(v)), "facts")


def _ratio_flags(facts):
    """Every line of more than a quarter of revenue counts as far above its peers, of a tenth as above."""
    lines = facts.where("revenue > 0").select("user_id", "revenue", F.explode("by_bucket").alias("bucket", "amount")).withColumn("your_pct", F.col("amount") / F.col("revenue")).where("your_pct > 0.1")
    return lines.select("user_id", F.concat(F.lit("ratio_"), "bucket", F.lit("_high")).alias("flag_key"), F.when(F.col("your_pct") > 0.25, "stands_out").otherwise("elevated").alias("severity"), "bucket", V.cents(F.col("amount")).alias("amount"), "your_pct", (F.col("your_pct") * 4).alias("weight")).where("bucket in ('subcontracts', 'insurance', 'travel', 'professional_fees')")


@query
def peer_facts(v):
    return _peer_facts(v).select("user_id", *[F.round(c, 4).alias(c) for c in ("revenue", "generic", "drawn", "spent")], "fragmented", F.size("by_bucket").alias("n_buckets"))


@query
def peer_flags(v):
    facts = _peer_facts(v)
    out = V.flags(facts, _ratio_flags(facts))
    return out.select("user_id", "flag_key", "layer", "severity", "bucket", "amount", F.round("your_pct", 9).alias("your_pct"), F.round("weight", 9).alias("weight"))


@query
def peer_band(v):
    facts = _peer_facts(v)
    dismissed = facts.where("user_id % 3 = 0").select("user_id", F.lit("pattern_travel_over_threshold").alias("flag_key"))
    return V.verdict(facts, V.flags(facts, _ratio_flags(facts)), dismissed)


@query
def vendor_cache_reuse(v):
    t = v.transactions.withColumn("vendor_key", S.vendor_key("description"))
    proofs = v.matches.where(P.proves()).select("user_id", F.col("transaction_id").alias("id"), F.lit(1).alias("p")).distinct()
    clusters = t.join(proofs, ["user_id", "id"], "left").groupBy("user_id", "vendor_key").agg(F.avg(F.coalesce("p", F.lit(0))).alias("proof_coverage"))
    odd = t.where("id % 2 = 1")
    alone = odd.groupBy("user_id", F.concat("vendor_key", F.lit("_only")).alias("vendor_key")).agg(F.lit(0.0).alias("proof_coverage"))
    cache = odd.groupBy("user_id", F.concat("vendor_key", F.lit("_only")).alias("vendor_key")).agg(F.when(F.min("id") % 2 == 1, F.when(F.col("user_id") == 2, "No such category").otherwise(F.max("category"))).alias("category"))
    return C.cached_decisions(clusters.unionByName(alone), cache.unionByName(t.groupBy("user_id", "vendor_key").agg(F.max("category").alias("category"))))


def _first_id(v, user_id):
    return P.tenant(v.transactions, user_id).agg(F.min("id")).first()[0]


@query
def link_picker_suggestions(v):
    return T.link_picker(v.transactions, v.links, 0, _first_id(v, 0), limit=100)


@query
def link_picker_search(v):
    """All rows of the tenant that say wire, transfer or business, the row itself among them."""
    return T.link_picker(v.transactions, v.links, 0, _first_id(v, 0), search=S.any_match("description", ["wire", "tfr", "transfer", "business"]), limit=500)


@query
def judged_links(v):
    """A model's verdicts on chains of rows: each row takes its best link."""
    verdicts = v.chain_links.select("user_id", F.col("source_transaction_id").alias("source_id"), F.col("target_transaction_id").alias("target_id"), F.lit("INTERNAL_TRANSFER").alias("link_type"), F.col("confidence_score").alias("factor"))
    return T.assign_judged(verdicts, v.transactions.withColumn("user_id", F.lit(0).cast("long"))).select("user_id", "source_id", "target_id", "link_type", "confidence", "chain_position")


@query
def upload_outcomes(v):
    """Receipts as uploads under changing extensions; a fifth is held already."""
    ext = F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".csv", ".docx"))), (F.col("id") % 4 + 1).cast("int"))
    up = v.receipts.select("user_id", F.concat(F.lit("u"), F.col("id").cast("string"), ext).alias("name"), "file_hash")
    return uploads.arrivals(up, v.receipts.where("status = 'MATCHED' and id % 3 = 0"))


@query
def orphaned_statements(v):
    jobs = v.jobs.select("user_id", "kind", F.when(F.col("status") == "pending", F.element_at(F.array(*map(F.lit, ("queued", "running", "waiting_for_model"))), (F.col("id") % 3 + 1).cast("int"))).otherwise(F.col("status")).alias("status"), F.when(F.col("id") % 7 == 0, "broken").otherwise(F.concat(F.lit('{"statement_id": '), (F.col("id") % 1000).cast("string"), F.lit("}"))).alias("result"))
    statements = v.jobs.where("id < 1000").select("user_id", "id", F.when(F.col("id") % 3 == 0, "done").otherwise("processing").alias("status"))
    return uploads.orphaned(statements, jobs)


@query
def vendor_key_sources(v):
    """Keys of rows by proof, description, stored key, model and slug."""
    proofs = v.matches.where(P.proves() & (F.col("transaction_id") % 3 == 0)).join(v.receipts.select("user_id", F.col("id").alias("document_id"), "vendor"), ["user_id", "document_id"]).groupBy("user_id", F.col("transaction_id").alias("id")).agg(F.min("vendor").alias("proof_vendor"))
    said = F.when(F.col("id") % 10 < 4, F.concat(F.lit("#"), F.col("id").cast("string"))).when(F.col("id") % 10 == 4, "").otherwise(F.col("description"))
    rows = v.transactions.withColumn("description", said).withColumn("stored_key", F.when(F.col("id") % 4 == 0, "kept")).withColumn("model_key", F.when(F.col("id") % 6 == 1, " Told "))
    return C.cluster_keys(rows.join(proofs, ["user_id", "id"], "left"))


@query
def run_result_with_documents(v):
    outcome = F.when(F.col("status") == "AUTO_APPROVED", "stored").when(F.col("status") == "USER_APPROVED", "refreshed").when(F.col("status") == "PENDING_REVIEW", "flagged").otherwise("displaced")
    return O.run_result(v.matches.select("user_id", outcome.alias("outcome")), v.transactions, U.unmatched_documents(v.receipts, v.matches))


@query
def action_items_by_profile(v):
    profiles = v.table("customer").where("c_custkey < 3").select(F.col("c_custkey").cast("long").alias("user_id"), (F.col("c_custkey") == 1).alias("onboarded"), (F.col("c_custkey") == 2).alias("connected"))
    t = v.transactions.withColumn("description", F.when(F.col("id") % 9 == 8, "WISE PAYMENTS 884120").otherwise(F.col("description")))
    return O.action_items(t, v.matches, profiles)


@query
def statement_csv_rows(v):
    """Statement files of all dialects, read line by line."""
    return Y.every(Y.parsed(v.csv_lines.select("file", "row", "value")))


@query
def order_export_lines(v):
    return Z.order_lines(Y.parsed(v.order_lines.select("file", "row", "value")))


@query
def order_export_shipments(v):
    return Z.shipments(Z.order_lines(Y.parsed(v.order_lines.select("file", "row", "value")))).select("date_posted", "amount", "currency", "description", "tax", "order_id", "source_row")


@query
def model_payload_rows(v):
    """Rows of a model's answer, one for each tenant and month, under changing names."""
    odd = F.col("id") % 2 == 1
    signed = F.when(F.col("id") % 3 == 0, S.money("amount")).otherwise(-P.absolute()).cast("string")
    m = F.map_filter(F.create_map(F.lit("date"), F.when(~odd, F.col("date_posted")), F.lit("posted"), F.when(odd, F.date_format(F.to_date("date_posted"), "MM/dd/yyyy")), F.lit("amount"), F.when(~odd, signed), F.lit("amt"), F.when(odd, F.concat(F.lit("$"), P.absolute().cast("string"), F.lit("CR"))), F.lit("type"), F.when(F.col("id") % 5 == 0, F.lit("credit")), F.lit("memo"), F.col("description")), lambda k, x: x.isNotNull())
    whole = v.transactions.groupBy(F.concat(F.lit("m"), F.col("user_id").cast("string"), F.lit("-"), F.substring("date_posted", 1, 7)).alias("file")).agg(F.array_sort(F.collect_list(F.struct("id", F.to_json(m).alias("j")))).alias("x"))
    text = F.concat(F.lit('```json\n{"transactions": ['), F.array_join(F.transform("x", lambda r: r["j"]), ", "), F.lit("]}\n```"))
    return Y.model_rows(whole.select("file", text.alias("json"))).select("file", F.col("row").cast("long").alias("row"), "date", "amount", "type", "description")


@query
def wallet_api_rows(v):
    d = v.transactions.select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 10 == 7, "P").otherwise("S").alias("status"), F.element_at(F.array(*map(F.lit, ("T0006", "T2001", "T1201", "", "T1301", "T0400"))), (F.col("id") % 6 + 1).cast("int")).alias("code"), "amount", "currency", F.concat("date_posted", F.lit("T10:00:00Z")).alias("at"), F.when(F.col("id") % 4 == 0, "Ann").otherwise(" ").alias("name"), F.when(F.col("id") % 4 == 1, "Subject").alias("subject"), F.when(F.col("id") % 4 == 2, "pay@harbour.example").otherwise("").alias("email"))
    return Y.api_rows(d).select("transaction_type", "date_posted", "amount", "currency", "description")


@query
def transfer_service_rows(v):
    value = S.money("amount")
    row = F.struct(F.when(F.col("id") % 6 == 0, "DEPOSIT").otherwise("CARD").alias("type"), F.concat("date_posted", F.lit("T01:02:03Z")).alias("date"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("REF-"), F.col("id").cast("string"))).alias("referenceNumber"), F.struct(value.alias("value"), F.when(F.col("id") % 5 > 0, F.col("currency")).alias("currency")).alias("amount"), F.struct(F.when(F.col("id") % 7 == 0, "FEE").otherwise("CARD").alias("type"), F.when(F.col("id") % 2 == 0, F.col("description")).alias("description")).alias("details"))
    return Y.transfer_service(v.transactions.select(F.to_json(F.struct(F.array(row).alias("transactions"))).alias("json"))).select("transaction_type", "date_posted", "amount", "currency", "description")


@query
def page_batches_merged(v):
    answer = F.to_json(F.struct("continuation", "vendor", "currency", "invoice_number", "grand_total_page", "has_grand_total", "total", "amount", "gst", F.col("weak").alias("_confidence"), F.array(F.struct(F.col("item").alias("description")), F.struct(F.lit("tax").alias("description"))).alias("line_items")))
    parts = D.batches(v.page_batches.select("user_id", "document_id", "batch", "last_page", answer.alias("json")))
    out = D.merged(parts.withColumn("_all", F.lit(12)).withColumn("_read", F.when(F.col("document_id") % 9 == 0, 10).otherwise(12)), "_all", "_read")
    return out.select("user_id", "document_id", "vendor", "currency", "invoice_number", "total", "gst", "amount", F.array_join("line_items", ";").alias("line_items"), F.size("claims").alias("n_claims"), "n_batches", "reasons")


@query
def workbook_rows(v):
    return J.read(v.book_rows.select("file", "sheet", "row", F.array("c1", "c2", "c3", "c4", "c5").alias("cells")))


@query
def benchmark_file_lines(v):
    block = lambda name, gap: [f"{name}\nsous-titre", "Quality Indicator", f"Bottom Quartile {name}", f"Lower  Middle {name}", "moved" if gap else f"Upper Middle {name}", f"Top Quartile {name}", "% of Businesses Reporting"]
    heads = [(f"f{k}", -1, ["NAICS", "Name", "Province", *block("Rent", False), *block("Net Profit/Loss", k == 1), "Rent"]) for k in (0, 1)]
    names = [f"a{k}" for k in range(11)]
    rows = v.benchmark_rows.select("file", "row", F.array(*names, "a4", "a5", "a6", "a7", "a8", "a9", "a3").alias("cells"))
    return J.benchmark_lines(rows.unionByName(v.spark.createDataFrame(heads, "file string, row long, cells array<string>")))


@query
def converted_by_day(v):
    rows = v.transactions.select("user_id", "id", F.when(F.col("id") % 7 == 3, "EUR").when(F.col("id") % 7 == 5, "GBP").otherwise(F.col("currency")).alias("currency"), F.to_date("date_posted").alias("day"), P.absolute().alias("value"))
    out = H.converted(rows, v.quotes, "value")
    return out.select("user_id", "id", "currency", "rate", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "in_base")


@query
def currencies_without_quotes(v):
    rows = v.transactions.select(F.when(F.col("id") % 7 == 5, "GBP").otherwise(F.col("currency")).alias("currency"))
    return H.missing(rows, v.quotes)


@query
def unambiguous_by_customer(v):
    """unambiguous_settled where every customer is a tenant, so that receipts with one candidate exist."""
    t, r = v.customer_transactions, v.customer_receipts
    return L.unambiguous(t, r, L.scored(L.close_pairs(t, r))).select("user_id", "transaction_id", "document_id")


@query
def candidate_counts_by_customer(v):
    """Candidates at any date, by amount and by printed amount, of each receipt with a stated currency."""
    d = v.customer_receipts.select("user_id", F.col("id").alias("document_id"), F.when(F.col("currency_source") != "assumed", F.col("currency")).alias("doc_ccy"), L.cents(F.abs(S.money("total"))).alias("doc_c"), F.lit(None).cast("long").alias("alt_c"))
    return L.candidate_counts(v.customer_transactions, d.where("doc_ccy is not null and doc_c > 0"))


@query
def review_actions_folded(v):
    return A.fold(v.review_events).where("kind = 'match'").select("user_id", "transaction_id", "match_id", "document_id", "status", "user_action", "match_type", "seq")


@query
def review_audit(v):
    return A.fold(v.review_events).where("kind = 'audit' and action <> 'LOAD'").select("user_id", "transaction_id", "seq", "action", "match_id", "outcome", "old_value")


@query
def review_resync(v):
    return A.resynced(A.fold(v.review_events), v.transactions, v.receipts, v.links)


def _businesses(v, since):
    """Customers as businesses: the segment is the industry, the nation's parity the band, every category a bucket."""
    who = v.table("customer").select(F.col("c_custkey").alias("business"), F.col("c_mktsegment").alias("naics"), F.when(F.col("c_acctbal") < 5000, "30K-5M").otherwise("5M-20M").alias("band"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("cohort"))
    rows = v.customer_transactions.where(F.col("date_posted") >= since).select(F.col("user_id").alias("business"), "transaction_type", F.coalesce("category", F.lit("other")).alias("bucket"), P.absolute().alias("value"))
    revenue = rows.where("transaction_type = 'CREDIT'").groupBy("business").agg(F.sum("value").alias("revenue"))
    spent = rows.where("transaction_type = 'DEBIT'").groupBy("business", "bucket").agg(F.sum("value").alias("amount"))
    return spent.join(revenue, "business").join(who, "business")


def _releases(v):
    return written(B.release(_businesses(v, "1998-01-01")), "cube"), B.release(_businesses(v, "1995-01-01"))


@query
def cube_line_errors(v):
    return B.line_errors(_releases(v)[0])


@query
def cube_compared(v):
    return B.compared(*_releases(v))


@query
def cube_verdict(v):
    new, old = _releases(v)
    cells = new.groupBy(*B.KEYS).agg((1 - F.sum("pct")).alias("net_profit_margin"), F.lit(0.5).alias("gross_margin"), F.lit(None).cast("double").alias("pct_profitable"), F.lit("A").alias("quality"))
    errors = B.line_errors(new).select(*B.KEYS, "error").unionByName(B.cell_errors(new, cells))
    return B.verdict(new, old, errors)


__all__ = ["QUERIES", "SparkSession", "Window", "X"]
