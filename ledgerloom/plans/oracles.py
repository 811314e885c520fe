"""SQL twins of the queries, for DuckDB over the driver's tables."""

from __future__ import annotations

from ..functions import tables as X
from .views import with_views

q = lambda xs: ", ".join("'" + str(x).replace("'", "''") + "'" for x in xs)
M = "DECIMAL(18,2)"
ABS = f"abs(CAST(amount AS {M}))"
NORM = "regexp_replace(lower(coalesce(category, '')), '[^a-z0-9]', '', 'g')"
KINDS = [c for c, k, *_ in X.TAXONOMY if k == "transfer"]
LINKED = f"""EXISTS (SELECT 1 FROM l WHERE l.user_id = t.user_id AND l.status <> 'USER_REJECTED' AND l.link_type IN ({q(X.TRANSFER_LINK_TYPES)}) AND (l.source_transaction_id = t.id OR l.target_transaction_id = t.id))"""
ENDS = """ends AS (SELECT user_id, source_transaction_id AS id FROM l WHERE status <> 'USER_REJECTED' UNION SELECT user_id, target_transaction_id FROM l WHERE status <> 'USER_REJECTED')"""
XENDS = f"""xends AS (SELECT user_id, source_transaction_id AS id FROM l WHERE status <> 'USER_REJECTED' AND link_type IN ({q(X.TRANSFER_LINK_TYPES)}) UNION SELECT user_id, target_transaction_id FROM l WHERE status <> 'USER_REJECTED' AND link_type IN ({q(X.TRANSFER_LINK_TYPES)}))"""
FLAGGED = f"""{XENDS}, f AS (SELECT t.*, {ABS} AS v, ({NORM} IN ({q(X.TRANSFER_CATEGORY_KEYS)}) OR coalesce(category IN ({q(KINDS)}), false) OR xends.id IS NOT NULL) AS x FROM t LEFT JOIN xends ON xends.user_id = t.user_id AND xends.id = t.id WHERE t.status <> 'EXCLUDED')"""
OWN = f"{FLAGGED}, o AS (SELECT * FROM f WHERE NOT x)"
S = lambda cond, v="v": f"CAST(coalesce(sum(CASE WHEN {cond} THEN {v} END), 0) AS {M})"
INC, EXP = "transaction_type = 'CREDIT'", "transaction_type = 'DEBIT'"
FLOWS = f"{S(INC)} AS income, {S(EXP)} AS expenses, CAST({S(INC)} - {S(EXP)} AS {M}) AS net, count(*) AS n"
TAXO = "tax(category, kind, section, bucket, gifi, scrutiny) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if z is None else (str(z) if isinstance(z, float) else "'" + z.replace("'", "''") + "'") for z in (c, k, s, b, g, w)) + ")" for c, k, s, b, g, _, _, w, _ in X.TAXONOMY) + ")"
FXT = "fx(currency, rate) AS (VALUES ('CAD', CAST(1.000000 AS DECIMAL(12,6))), ('USD', CAST(1.370000 AS DECIMAL(12,6))))"
FLAGS = f"""{ENDS}, mt AS (SELECT DISTINCT user_id, transaction_id AS id FROM m WHERE status <> 'USER_REJECTED'),
 s AS (SELECT t.*, mt.id IS NOT NULL AS matched, ends.id IS NOT NULL AS linked, (mt.id IS NOT NULL OR ends.id IS NOT NULL OR t.status = 'IGNORED') AS resolved
 FROM t LEFT JOIN mt ON mt.user_id = t.user_id AND mt.id = t.id LEFT JOIN ends ON ends.user_id = t.user_id AND ends.id = t.id WHERE t.status <> 'EXCLUDED')"""
KPI = "count(*) AS total, count(*) FILTER (status = 'IGNORED') AS ignored, count(*) FILTER (resolved) AS resolved, count(*) FILTER (matched) AS matched, count(*) FILTER (linked) AS linked, CAST(count(*) FILTER (resolved) AS DOUBLE) / count(*) AS rate"
GM = lambda c: f"CASE WHEN regexp_matches({c}, '^-?[0-9]+(\\.[0-9]+)?$') THEN CAST({c} AS {M}) ELSE CAST(0 AS {M}) END"
PROOF = "('AUTO_APPROVED', 'USER_APPROVED')"


def breakdown(where: str = "true", name: str = "o") -> str:
    return f"SELECT user_id, coalesce(category, 'Uncategorized') AS category, currency, {FLOWS} FROM {name} WHERE {where} GROUP BY ALL"


ORACLES: dict[str, str] = {
    "category_breakdown": with_views("tl", f", {OWN} {breakdown()}"),
    "category_breakdown_range": with_views("tl", f", {OWN} {breakdown("date_posted BETWEEN '1996-01-01' AND '1996-12-31'")}"),
    "monthly_trend": with_views("tl", f", {OWN} SELECT user_id, substr(date_posted, 1, 7) AS month, currency, {FLOWS} FROM o GROUP BY ALL"),
    "period_financials": with_views("tl", f""", {OWN}, g AS (SELECT user_id, currency, {FLOWS} FROM o WHERE date_posted LIKE '1997-03%' GROUP BY ALL)
 SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY currency <> 'CAD', currency <> 'USD', income + expenses DESC, currency) AS INT) AS rank FROM g"""),
    "current_previous_ytd": with_views("tl", f", {OWN} SELECT user_id, currency, " + ", ".join(f"{S(f'{p} AND {k}')} AS {n}_{lab}" for n, p in (("current", "substr(date_posted, 1, 7) = '1998-05'"), ("previous", "substr(date_posted, 1, 7) = '1998-04'"), ("ytd", "substr(date_posted, 1, 4) = '1998' AND substr(date_posted, 1, 7) <= '1998-05'")) for k, lab in ((INC, "income"), (EXP, "expenses"))) + " FROM o WHERE date_posted >= '1998' GROUP BY ALL"),
    "dashboard_kpi": with_views("tml", f", {FLAGS} SELECT user_id, {KPI} FROM s GROUP BY user_id"),
    "monthly_status_grid": with_views("tml", f""", {FLAGS}, g AS (SELECT user_id, CAST(substr(date_posted, 6, 2) AS INT) AS month, {KPI} FROM s WHERE date_posted LIKE '1999-%' GROUP BY ALL)
 SELECT u.user_id, CAST(n.month AS INT) AS month, coalesce(total, 0) AS total, coalesce(ignored, 0) AS ignored, coalesce(resolved, 0) AS resolved, coalesce(matched, 0) AS matched, coalesce(linked, 0) AS linked, coalesce(rate, 0.0) AS rate
 FROM (SELECT DISTINCT user_id FROM t) u CROSS JOIN (SELECT unnest(range(1, 13)) AS month) n LEFT JOIN g ON g.user_id = u.user_id AND g.month = n.month"""),
    "year_index": with_views("tml", f""", {FLAGS}, {XENDS}, y AS (SELECT s.*, {ABS.replace('amount', 's.amount')} AS v, NOT ({NORM.replace('category', 's.category')} IN ({q(X.TRANSFER_CATEGORY_KEYS)}) OR coalesce(s.category IN ({q(KINDS)}), false) OR xends.id IS NOT NULL) AS own
 FROM s LEFT JOIN xends ON xends.user_id = s.user_id AND xends.id = s.id)
 SELECT user_id, CAST(substr(date_posted, 1, 4) AS INT) AS year, count(*) AS n, {S(f"own AND {INC} AND currency = 'CAD'")} AS income_cad, {S(f"own AND {EXP} AND currency = 'CAD'")} AS expenses_cad,
 count(DISTINCT substr(date_posted, 1, 7)) AS months, count(DISTINCT account) AS accounts, CAST(count(*) FILTER (resolved) AS DOUBLE) / count(*) AS rate FROM y GROUP BY ALL"""),
    "tax_summary": with_views("r", f""", p AS (SELECT user_id, coalesce(currency, 'CAD') AS currency, {GM("coalesce(tax_gst, '')")} AS g, {GM("coalesce(tax_hst, '')")} AS h,
 unnest(CASE WHEN document_date IS NULL THEN ['undated'] ELSE [substr(document_date, 1, 7), substr(document_date, 1, 4) || '-Q' || CAST((CAST(substr(document_date, 6, 2) AS INT) + 2) // 3 AS VARCHAR), substr(document_date, 1, 4)] END) AS period FROM r)
 SELECT user_id, period, currency, CAST(sum(g) AS {M}) AS gst, CAST(sum(h) AS {M}) AS hst, count(*) FILTER (g + h <> 0) AS taxed, count(*) AS n FROM p GROUP BY ALL"""),
    "doc_tax_by_txn": with_views("mr", f"SELECT m.user_id, m.transaction_id, CAST(sum({GM("coalesce(r.tax_gst, '')")}) AS {M}) AS gst, CAST(sum({GM("coalesce(r.tax_hst, '')")}) AS {M}) AS hst, count(*) AS documents FROM m JOIN r ON r.user_id = m.user_id AND r.id = m.document_id WHERE m.status IN {PROOF} GROUP BY ALL"),
    "category_pnl_rollup": with_views("tl", f""", {OWN}, {TAXO} SELECT user_id, currency, section, category, CAST(sum(s) AS {M}) AS net, count(*) AS n, CAST(grouping(user_id, currency, section, category) AS INT) AS level FROM
 (SELECT o.user_id, o.currency, coalesce(tax.section, 'other') AS section, coalesce(o.category, 'Uncategorized') AS category, CASE WHEN {INC} THEN v ELSE -v END AS s FROM o LEFT JOIN tax ON tax.category = o.category)
 GROUP BY ROLLUP (user_id, currency, section, category) HAVING grouping(user_id) = 0 AND grouping(currency) = 0"""),
    "category_share_and_previous": with_views("tl", f""", {OWN}, {TAXO}, a AS ({breakdown("date_posted LIKE '1998-05%'")}), b AS ({breakdown("date_posted LIKE '1998-04%'")}),
 c AS (SELECT a.user_id, a.category, a.currency, a.net, coalesce(tax.section, 'other') AS section FROM a LEFT JOIN tax ON tax.category = a.category),
 d AS (SELECT *, sum(abs(net)) OVER (PARTITION BY user_id, currency, section) AS size FROM c)
 SELECT d.user_id, d.category, d.currency, d.net, d.section, CASE WHEN size > 0 THEN CAST(abs(d.net) AS DOUBLE) / CAST(size AS DOUBLE) ELSE 0.0 END AS share, b.net AS previous_net, CAST(d.net - b.net AS {M}) AS change
 FROM d LEFT JOIN b ON b.user_id = d.user_id AND b.category = d.category AND b.currency = d.currency"""),
    "to_cad_totals": with_views("tl", f", {OWN}, {FXT}, g AS (SELECT user_id, currency, {FLOWS} FROM o GROUP BY ALL) SELECT user_id, CAST(CASE WHEN count(rate) = count(*) THEN sum(CAST(net * rate AS DECIMAL(24,6))) END AS {M}) AS net_base, count(*) AS currencies FROM g LEFT JOIN fx ON fx.currency = g.currency GROUP BY user_id"),
    "account_month_report": with_views("tl", f""", {FLAGGED}, g AS (SELECT user_id, account, currency, count(*) AS n, {S(f'NOT x AND {INC}')} AS money_in, {S(f'NOT x AND {EXP}')} AS money_out, count(*) FILTER (x) AS transfers FROM f WHERE date_posted LIKE '1997-07%' GROUP BY ALL)
 SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(list_position([{q(X.ACCOUNT_ORDER)}], account), 1000), account, currency) AS INT) AS place FROM g"""),
    "status_counts_dense": with_views("t", "SELECT u.user_id, s.status, count(t.id) AS n FROM (SELECT DISTINCT user_id FROM t) u CROSS JOIN (SELECT unnest(['UNMATCHED', 'MATCHED', 'IGNORED', 'EXCLUDED', 'PENDING', 'LINKED']) AS status) s LEFT JOIN t ON t.user_id = u.user_id AND t.status = s.status GROUP BY ALL"),
    "job_counts_by_kind": with_views("j", "SELECT u.user_id, s.kind, count(j.id) AS n FROM (SELECT DISTINCT user_id FROM j WHERE status = 'pending') u CROSS JOIN (SELECT unnest(['receipt', 'statement']) AS kind) s LEFT JOIN j ON j.user_id = u.user_id AND j.kind = s.kind AND j.status = 'pending' GROUP BY ALL"),
    "date_range": with_views("t", "SELECT user_id, min(date_posted) AS first_date, max(date_posted) AS last_date, max(substr(date_posted, 1, 7)) AS latest_month FROM t GROUP BY user_id"),
    "grid_page": with_views("t", f"SELECT id, date_posted, CAST(amount AS {M}) AS amount, status FROM t WHERE user_id = 1 AND status = 'UNMATCHED' AND date_posted LIKE '1997%' AND {ABS} >= 1000 ORDER BY CAST(amount AS {M}) DESC NULLS LAST, id DESC LIMIT 50 OFFSET 100"),
    "row_page_number": with_views("t", ", p AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY date_posted, id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM t) SELECT user_id, id, place, (place - 1) // 50 + 1 AS page, total FROM p"),
    "recent_transactions": with_views("t", "SELECT user_id, id, date_posted, CAST(row_number() OVER (PARTITION BY user_id ORDER BY date_posted DESC, id DESC) AS INT) AS place FROM t QUALIFY place <= 25"),
    "txn_search": with_views("t", "SELECT user_id, id, description FROM t WHERE " + " OR ".join(f"coalesce({c}, '') ILIKE '%orchid%'" for c in ("description", "account", "status", "category", "note", "source_file", "date_posted", "amount"))),
    "txn_search_amount": with_views("t", "SELECT user_id, id, description FROM t WHERE id = 4242 OR " + " OR ".join(f"coalesce({c}, '') ILIKE '%#4242%'" for c in ("description", "account", "status", "category", "note", "source_file", "date_posted", "amount"))),
    "doc_search_fuzzy": with_views("r", "SELECT user_id, id, vendor FROM r WHERE " + " OR ".join([f"coalesce({c}, '') ILIKE '%bluepek%'" for c in ("vendor", "original_filename", "currency", "document_date")] + [f"lower(coalesce({c}, '')) LIKE '{p}'" for c in ("vendor", "original_filename") for p in
        ["%_luepek%", "%b_uepek%", "%bl_epek%", "%blu_pek%", "%blue_ek%", "%bluep_k%", "%bluepe_%", "%luepek%", "%buepek%", "%blepek%", "%blupek%", "%blueek%", "%bluepk%", "%bluepe%", "%b_luepek%", "%bl_uepek%", "%blu_epek%", "%blue_pek%", "%bluep_ek%", "%bluepe_k%"]])),
    "linkable_pool": with_views("tl", f", {ENDS} SELECT user_id, id, date_posted, status FROM t WHERE status IN ('UNMATCHED', 'IGNORED') AND NOT EXISTS (SELECT 1 FROM ends WHERE ends.user_id = t.user_id AND ends.id = t.id)"),
    "linked_ids": with_views("l", f", {ENDS} SELECT user_id, id FROM ends"),
    "unmatched_docs_distinct": with_views("rm", "SELECT user_id, min(id) AS id, file_hash FROM r WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.user_id = r.user_id AND m.document_id = r.id AND m.status <> 'USER_REJECTED') GROUP BY user_id, file_hash"),
    "matches_with_both_sides": with_views("mtr", f"SELECT m.user_id, m.id, m.status, t.description, CAST(t.amount AS {M}) AS amount, r.vendor, {GM('r.total')} AS total FROM m LEFT JOIN t ON t.user_id = m.user_id AND t.id = m.transaction_id LEFT JOIN r ON r.user_id = m.user_id AND r.id = m.document_id"),
    "document_list_with_txns": with_views("rm", ", a AS (SELECT user_id, document_id, min(transaction_id) AS f, count(*) AS n, string_agg(CAST(transaction_id AS VARCHAR), ',' ORDER BY transaction_id) AS ids FROM m WHERE status <> 'USER_REJECTED' GROUP BY ALL) SELECT r.user_id, r.id, r.vendor, r.file_hash, a.f AS first_transaction, coalesce(a.n, 0) AS n_matches, a.ids AS transaction_ids FROM r LEFT JOIN a ON a.user_id = r.user_id AND a.document_id = r.id"),
    "links_both_directions": with_views("lt", f""", e AS (SELECT user_id, id AS link_id, link_type, source_transaction_id AS transaction_id, target_transaction_id AS other_id, 'source' AS side FROM l WHERE status <> 'USER_REJECTED' UNION ALL SELECT user_id, id, link_type, target_transaction_id, source_transaction_id, 'target' FROM l WHERE status <> 'USER_REJECTED')
 SELECT e.user_id, e.other_id, e.transaction_id, e.link_id, e.link_type, e.side, b.account AS other_account, CAST(b.amount AS {M}) AS other_amount, b.date_posted AS other_date FROM e JOIN t a ON a.user_id = e.user_id AND a.id = e.transaction_id JOIN t b ON b.user_id = e.user_id AND b.id = e.other_id"""),
    "unified_proof": with_views("mrlt", """, e AS (SELECT user_id, link_type, source_transaction_id AS a, target_transaction_id AS b FROM l WHERE status <> 'USER_REJECTED' UNION ALL SELECT user_id, link_type, target_transaction_id, source_transaction_id FROM l WHERE status <> 'USER_REJECTED')
 SELECT m.user_id, m.transaction_id, 'document' AS kind, m.document_id AS proof_id, r.vendor AS label FROM m JOIN r ON r.user_id = m.user_id AND r.id = m.document_id WHERE m.status IN ('AUTO_APPROVED', 'USER_APPROVED', 'PENDING_REVIEW')
 UNION ALL SELECT e.user_id, e.a, 'link', e.b, e.link_type FROM e JOIN t x ON x.user_id = e.user_id AND x.id = e.a JOIN t y ON y.user_id = e.user_id AND y.id = e.b"""),
    "proof_coverage": with_views("tmr", f""", g AS (SELECT m.user_id, m.transaction_id, CAST(sum(CASE WHEN coalesce(r.currency, t.currency) = t.currency THEN abs({GM('r.total')}) END) AS {M}) AS covered, max(abs(CAST(t.amount AS {M}))) AS value, count(*) AS proofs
 FROM m JOIN r ON r.user_id = m.user_id AND r.id = m.document_id JOIN t ON t.user_id = m.user_id AND t.id = m.transaction_id WHERE m.status IN {PROOF} GROUP BY ALL)
 SELECT *, CASE WHEN value > 0 AND covered IS NOT NULL THEN CAST(covered AS DOUBLE) / CAST(value AS DOUBLE) END AS share, coalesce(covered >= value * 0.95, false) AS is_covered FROM g"""),
    "stored_coverage": with_views("m", f"SELECT user_id, transaction_id, bool_or(covered_amount IS NULL) AS whole, CAST(sum({GM("coalesce(covered_amount, '0')")}) AS {M}) AS part FROM m WHERE status IN {PROOF} GROUP BY ALL"),
    "link_offset": with_views("lt", f""", g AS (SELECT l.user_id, l.source_transaction_id, max(abs(CAST(a.amount AS {M}))) AS anchor, CAST(coalesce(sum(CASE WHEN a.currency = b.currency AND a.transaction_type <> b.transaction_type THEN abs(CAST(b.amount AS {M})) END), 0) AS {M}) AS "offset", count(*) AS legs,
 count(*) FILTER (NOT (a.currency = b.currency AND a.transaction_type <> b.transaction_type)) AS ignored_legs FROM l JOIN t a ON a.user_id = l.user_id AND a.id = l.source_transaction_id JOIN t b ON b.user_id = l.user_id AND b.id = l.target_transaction_id WHERE l.status <> 'USER_REJECTED' GROUP BY ALL)
 SELECT *, CAST(greatest(anchor - "offset", 0) AS {M}) AS net, "offset" >= anchor * 0.99 AS fully FROM g"""),
    "available_docs_with_counts": with_views("rm", "SELECT r.user_id, r.id, r.vendor, count(m.id) AS existing, r.status = 'EXTRACTED' AS is_open FROM r LEFT JOIN m ON m.user_id = r.user_id AND m.document_id = r.id AND m.status <> 'USER_REJECTED' GROUP BY r.user_id, r.id, r.vendor, r.status"),
    "binder_tally": with_views("tmrl", f""", {ENDS}, p AS (SELECT m.user_id, m.transaction_id AS id, bool_or(r.original_filename IS NOT NULL) AS file FROM m LEFT JOIN r ON r.user_id = m.user_id AND r.id = m.document_id WHERE m.status IN {PROOF} GROUP BY ALL)
 SELECT t.user_id, CASE WHEN p.file THEN 'proof_file' WHEN p.file IS NOT NULL THEN 'match_without_file' WHEN ends.id IS NOT NULL THEN 'linked' WHEN t.status = 'IGNORED' THEN 'ignored' WHEN t.note IS NOT NULL THEN 'note' ELSE 'missing' END AS bucket, count(*) AS n
 FROM t LEFT JOIN p ON p.user_id = t.user_id AND p.id = t.id LEFT JOIN ends ON ends.user_id = t.user_id AND ends.id = t.id WHERE t.status <> 'EXCLUDED' GROUP BY ALL"""),
    "net_income_by_sheet": with_views("t", f", o AS (SELECT *, {ABS} AS v FROM t WHERE status <> 'EXCLUDED' AND {NORM} NOT IN ({q(X.TRANSFER_CATEGORY_KEYS)})) SELECT user_id, account || ' ' || substr(date_posted, 1, 7) AS sheet, currency, {FLOWS} FROM o GROUP BY ALL"),
    "heaviest_source_file": with_views("t", ", g AS (SELECT user_id, source_file, count(*) AS n FROM t WHERE account = 'Wise' AND date_posted BETWEEN '1996-01-01' AND '1997-12-31' GROUP BY ALL) SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, source_file) = 1"),
    "first_of_duplicates": with_views("t", "SELECT user_id, source_file, min(id) AS id FROM t GROUP BY user_id, source_file, date_posted, abs(CAST(amount AS DECIMAL(18,2))), substr(description, 1, 40)"),
    "insert_counts": with_views("t", "SELECT source_file, count(*) + count(*) FILTER (transaction_type = 'CREDIT') AS total, count(*) FILTER (status <> 'MATCHED') AS inserted, count(*) + count(*) FILTER (transaction_type = 'CREDIT') - count(*) FILTER (status <> 'MATCHED') AS duplicates FROM t GROUP BY source_file"),
    "queue_ahead": with_views("j", "SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, position, id) - 1 AS ahead FROM j WHERE status = 'pending'"),
    "job_eta": with_views("j", """, a AS (SELECT user_id, kind, avg(seconds) AS average FROM (SELECT * FROM j WHERE status = 'done' QUALIFY row_number() OVER (PARTITION BY user_id, kind ORDER BY created_at DESC, id DESC) <= 20) GROUP BY ALL),
 p AS (SELECT user_id, kind, count(*) FILTER (status = 'pending') AS pending FROM j GROUP BY ALL)
 SELECT p.user_id, CAST(sum(pending) AS BIGINT) AS pending, round(sum(coalesce(average, CASE kind WHEN 'receipt' THEN 25.0 ELSE 90.0 END) * pending) / 4, 4) AS eta_seconds FROM p LEFT JOIN a USING (user_id, kind) GROUP BY p.user_id"""),
    "job_batches": with_views("j", """, f AS (SELECT *, CASE WHEN status <> 'pending' THEN created_at_s + floor(seconds) END AS done FROM (SELECT *, epoch(date_trunc('second', created_at)) AS created_at_s FROM j)),
 g AS (SELECT *, max(coalesce(to_timestamp(done)::TIMESTAMP, TIMESTAMP '9999-12-31')) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM f),
 h AS (SELECT *, sum(CASE WHEN latest IS NULL OR latest <= created_at THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY created_at, id) AS batch FROM g)
 SELECT user_id, CAST(batch AS BIGINT) AS batch, min(id) AS anchor, count(*) AS n, count(done) AS finished FROM h GROUP BY ALL"""),
    "transfers_sheet": with_views("lt", f"""SELECT l.user_id, l.target_transaction_id, l.source_transaction_id, l.id, l.link_type, a.date_posted AS source_date, a.account AS source_account, CASE WHEN a.transaction_type = 'CREDIT' THEN 1 ELSE -1 END * abs(CAST(a.amount AS {M})) AS source_amount,
 b.date_posted AS target_date, b.account AS target_account, CASE WHEN b.transaction_type = 'CREDIT' THEN 1 ELSE -1 END * abs(CAST(b.amount AS {M})) AS target_amount
 FROM l LEFT JOIN t a ON a.user_id = l.user_id AND a.id = l.source_transaction_id LEFT JOIN t b ON b.user_id = l.user_id AND b.id = l.target_transaction_id WHERE l.status <> 'USER_REJECTED'"""),
    "shipment_groups": f"SELECT l_orderkey AS order_id, CAST(l_shipdate AS DATE) AS ship_date, CAST(sum(CAST(l_extendedprice AS {M})) AS {M}) AS total, CAST(sum(CAST(CAST(l_extendedprice AS {M}) * CAST(l_tax AS DECIMAL(4,2)) AS {M})) AS {M}) AS tax, count(*) AS items FROM lineitem GROUP BY ALL",
    "document_twins": with_views("r", f""", k AS (SELECT user_id, id, 'h:' || file_hash AS key FROM r UNION SELECT user_id, id, concat('i:', regexp_replace(lower(coalesce(vendor, '')), '[^a-z0-9]', '', 'g'), '|', {GM('total')}, '|', coalesce(currency, ''), '|', document_date) FROM r WHERE vendor IS NOT NULL AND total IS NOT NULL AND document_date IS NOT NULL)
 SELECT DISTINCT a.user_id, a.id, b.id AS twin FROM k a JOIN k b ON a.user_id = b.user_id AND a.key = b.key AND a.id <> b.id"""),
    "link_walk": with_views("tc", """, e AS (SELECT source_transaction_id AS u, target_transaction_id AS v FROM c WHERE status <> 'USER_REJECTED' UNION SELECT target_transaction_id, source_transaction_id FROM c WHERE status <> 'USER_REJECTED'),
 w AS (SELECT id AS seed, id, 0 AS depth, [id] AS seen FROM t UNION ALL SELECT w.seed, e.v, w.depth + 1, list_append(w.seen, e.v) FROM w JOIN e ON e.u = w.id WHERE w.depth < 19 AND NOT list_contains(w.seen, e.v))
 SELECT seed, id, CAST(min(depth) AS INT) AS depth FROM w GROUP BY seed, id""", recursive=True),
    "nearest_proof": with_views("tmc", f""", e AS (SELECT source_transaction_id AS u, target_transaction_id AS v FROM c WHERE status IN {PROOF} UNION SELECT target_transaction_id, source_transaction_id FROM c WHERE status IN {PROOF}),
 s AS (SELECT transaction_id AS id, max(confidence_score) AS conf FROM m WHERE status IN {PROOF} GROUP BY transaction_id),
 w AS (SELECT id AS seed, id, 0 AS depth, [id] AS seen FROM s UNION ALL SELECT w.seed, e.v, w.depth + 1, list_append(w.seen, e.v) FROM w JOIN e ON e.u = w.id WHERE w.depth < 20 AND NOT list_contains(w.seen, e.v)),
 n AS (SELECT w.id, w.depth, w.seed FROM w JOIN s ON s.id = w.seed QUALIFY row_number() OVER (PARTITION BY w.id ORDER BY w.depth, s.conf DESC, w.seed) = 1)
 SELECT CAST(0 AS BIGINT) AS user_id, id, CAST(depth AS INT) AS depth, seed FROM n WHERE depth > 0""", recursive=True),
    "transfer_chains": with_views("c", f""", o AS (SELECT id, source_transaction_id AS u, target_transaction_id AS v, confidence_score FROM c WHERE status IN {PROOF}),
 e AS (SELECT u, v FROM o UNION SELECT v, u FROM o), w AS (SELECT u AS id, u AS r FROM e UNION SELECT w.id, e.v FROM w JOIN e ON e.u = w.r), k AS (SELECT id, min(r) AS component FROM w GROUP BY id)
 SELECT CAST(0 AS BIGINT) AS user_id, o.id AS link_id, substr(sha256('0:' || CAST(component AS VARCHAR)), 1, 32) AS chain_id, component, CAST(row_number() OVER (PARTITION BY component ORDER BY o.id) - 1 AS INT) AS chain_position, avg(confidence_score) OVER (PARTITION BY component) AS total_confidence
 FROM o JOIN k ON k.id = o.u QUALIFY count(*) OVER (PARTITION BY component) >= 2""", recursive=True),
    "link_components": with_views("c", """, e AS (SELECT source_transaction_id AS u, target_transaction_id AS v FROM c WHERE status <> 'USER_REJECTED' UNION SELECT target_transaction_id, source_transaction_id FROM c WHERE status <> 'USER_REJECTED'),
 w AS (SELECT u AS id, u AS r FROM e UNION SELECT w.id, e.v FROM w JOIN e ON e.u = w.r) SELECT CAST(0 AS BIGINT) AS user_id, id, min(r) AS component FROM w GROUP BY id""", recursive=True),
    "derived_status": with_views("tml", f""", e AS (SELECT user_id, source_transaction_id AS id FROM l WHERE status IN {PROOF} UNION SELECT user_id, target_transaction_id FROM l WHERE status IN {PROOF}), g AS (SELECT user_id, transaction_id AS id, bool_or(status IN {PROOF}) AS a, bool_or(status = 'PENDING_REVIEW') AS p FROM m GROUP BY ALL)
 SELECT t.user_id, t.id, t.status, CASE WHEN t.status IN ('EXCLUDED', 'IGNORED') THEN t.status WHEN coalesce(g.a, false) THEN 'MATCHED' WHEN e.id IS NOT NULL THEN 'LINKED' WHEN coalesce(g.p, false) THEN t.status ELSE 'UNMATCHED' END AS derived
 FROM t LEFT JOIN g ON g.user_id = t.user_id AND g.id = t.id LEFT JOIN e ON e.user_id = t.user_id AND e.id = t.id"""),
    "rule_categories": with_views("t", "SELECT user_id, id, CASE " + " ".join("WHEN " + " OR ".join((f"(regexp_matches(description, '(?i){p.replace('(?!Fee)', '')}') AND NOT regexp_matches(description, '(?i)INTERACe-TransferFee'))" if "(?!Fee)" in p else f"regexp_matches(description, '(?i){p}')") for p in ps) + f" THEN '{c}'" for c, _, ps in X.CATEGORY_RULES) + " ELSE 'Uncategorized' END AS category, (" + " OR ".join(f"regexp_matches(description, '(?i){p}')" for _, s, ps in X.CATEGORY_RULES if s for p in ps) + ") AS settled FROM t"),
    "running_balance": with_views("t", """, s AS (SELECT user_id, source_file, substr(date_posted, 1, 7) AS month, id, date_posted, CASE WHEN transaction_type = 'CREDIT' THEN 1 ELSE -1 END * abs(CAST(amount AS DECIMAL(18,2))) AS signed FROM t),
 b AS (SELECT *, sum(signed) OVER w + CASE WHEN id % 23 = 0 THEN 1.00 ELSE 0.00 END AS balance FROM s WINDOW w AS (PARTITION BY user_id, source_file, month ORDER BY date_posted, id)),
 c AS (SELECT *, coalesce(abs(balance - lag(balance) OVER (PARTITION BY user_id, source_file, month ORDER BY date_posted, id) - signed) > 0.02, false) AS bad FROM b)
 SELECT user_id, source_file, month, count(*) AS checked, count(*) FILTER (bad) AS bad, count(*) FILTER (bad) * 20 > count(*) AS inconsistent FROM c GROUP BY ALL"""),
    "receipt_candidates": with_views("trm", f""", {{twins}}, bad AS (SELECT DISTINCT user_id, transaction_id, document_id FROM m WHERE status = 'USER_REJECTED'), bad2 AS (SELECT * FROM bad UNION SELECT bad.user_id, bad.transaction_id, tw.twin FROM bad JOIN tw ON tw.user_id = bad.user_id AND tw.id = bad.document_id), {{naive}}
 SELECT user_id, transaction_id, document_id, match_reason, gap FROM cand WHERE match_reason IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad2 b WHERE b.user_id = cand.user_id AND b.transaction_id = cand.transaction_id AND b.document_id = cand.document_id)"""),
}

TWINS = "k AS (" + ORACLES["document_twins"].split(" k AS (", 1)[1].replace("SELECT DISTINCT a.user_id", "tw AS (SELECT DISTINCT a.user_id") .replace(")\n tw AS", "),\n tw AS") + ")"
NAIVE = f"""p AS (SELECT t.user_id, t.id AS transaction_id, r.id AS document_id, t.description, t.account, t.currency, abs(CAST(t.amount AS {M})) AS a, abs(TRY_CAST(r.total AS {M})) AS d, CASE WHEN r.currency_source <> 'assumed' THEN r.currency END AS c, abs(date_diff('day', CAST(t.date_posted AS DATE), CAST(r.document_date AS DATE))) AS g
 FROM t JOIN r ON r.user_id = t.user_id WHERE t.status = 'UNMATCHED' AND t.transaction_type = 'DEBIT'),
 cand AS (SELECT *, CAST(coalesce(g, 1000000) AS INT) AS gap, CASE
 WHEN coalesce(c, currency) = currency AND abs(a - d) <= 2 THEN 'same_currency_close'
 WHEN coalesce(c, currency) = currency AND abs(a - d) <= d * 0.15 THEN 'same_currency_15pct'
 WHEN coalesce(c, currency) <> currency AND ((currency = 'CAD' AND c = 'USD' AND a BETWEEN d * 1.20 AND d * 1.55) OR (currency = 'USD' AND c = 'CAD' AND d BETWEEN a * 1.20 AND a * 1.55)) THEN 'fx_band'
 WHEN coalesce(c, currency) = currency AND currency = 'CAD' AND regexp_matches(description, '(?i)WISEMSP|WISE\\s*MSP|WISE\\s*PAYMENTS|PAYPALMSP|PAYPAL\\s*MSP|OUTGOING\\s*WIRE') AND a BETWEEN d * 1.20 AND d * 1.55 THEN 'intermediary_fx' END AS match_reason
 FROM p WHERE d > 0 AND (g <= 45 OR (g IS NULL AND a BETWEEN d * 0.5 - 30 AND d * 2 + 30)))"""
ORACLES["receipt_candidates"] = ORACLES["receipt_candidates"].replace("{twins}", TWINS).replace("{naive}", NAIVE)
_SCORE = """CASE WHEN coalesce(c, currency) = currency AND abs(a - d) = 0 THEN 1.0 WHEN coalesce(c, currency) = currency AND abs(a - d) <= 0.05 THEN 0.9 WHEN coalesce(c, currency) = currency AND abs(a - d) <= 2 THEN 0.8 WHEN coalesce(c, currency) = currency THEN {same} WHEN match_reason = 'fx_band' THEN 0.78 ELSE 0.0 END"""
ORACLES["amount_verdict"] = with_views("tr", f""", {NAIVE} SELECT user_id, transaction_id, document_id, CASE WHEN coalesce(c, currency) = currency AND abs(a - d) <= 2 THEN CASE WHEN c IS NULL THEN 'assumed_same_currency' WHEN a = d THEN 'exact' WHEN abs(a - d) <= 0.05 THEN 'rounding' ELSE 'within_tolerance' END
 WHEN coalesce(c, currency) = currency THEN 'mismatch' WHEN match_reason = 'fx_band' THEN 'fx_band' ELSE 'mismatch' END AS verdict, CAST({_SCORE.format(same='0.0')} AS DOUBLE) AS score FROM cand WHERE match_reason IS NOT NULL""")
_DATE = "CASE WHEN gap >= 1000000 THEN 0.1 WHEN gap = 0 THEN 1.0 WHEN gap <= 3 THEN 0.9 WHEN gap <= 7 THEN 0.7 WHEN gap <= 14 THEN 0.5 WHEN gap <= 21 THEN 0.4 WHEN gap <= 45 THEN 0.2 ELSE 0.02 END"
_AMOUNT = _SCORE.format(same="(CASE WHEN abs(a - d) <= 25 THEN 0.65 ELSE 0.3 END)")
ORACLES["receipt_first_round"] = with_views("tr", f""", {NAIVE}, s AS (SELECT *, CAST({_AMOUNT} AS DOUBLE) AS am, CAST({_DATE} AS DOUBLE) AS da FROM cand WHERE match_reason IS NOT NULL), z AS (SELECT *, 0.5::DOUBLE * am + 0.3::DOUBLE * da + 0.2::DOUBLE * 0.5::DOUBLE AS conf FROM s),
 b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY user_id, document_id ORDER BY conf DESC, gap, transaction_id) = 1)
 SELECT user_id, transaction_id, document_id FROM b QUALIFY row_number() OVER (PARTITION BY user_id, transaction_id ORDER BY (conf < 0.60 OR am <= 0.05), conf DESC, am DESC, gap, document_id) = 1""")
ORACLES["rejected_pairs_expanded"] = with_views("mr", f", {TWINS}, bad AS (SELECT DISTINCT user_id, transaction_id, document_id FROM m WHERE status = 'USER_REJECTED') SELECT * FROM bad UNION SELECT bad.user_id, bad.transaction_id, tw.twin FROM bad JOIN tw ON tw.user_id = bad.user_id AND tw.id = bad.document_id")

# text keys
_HEAD = "trim(regexp_replace(trim(coalesce(description, '')), '(?i)" + X.PROCESSOR_PREFIX + "', ''))"
for _p in (r"\b\d{6,}\b", r"\*[A-Z0-9]+", r"#\d+", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{2,4}\b", r"(?i)\s+[A-Z]\b", "(?i)" + X.NOISE_TOKENS):
    _HEAD = f"regexp_replace({_HEAD}, '{_p}', ' ', 'g')"
_HEAD = f"lower(array_to_string(list_filter(string_split_regex({_HEAD}, '\\s+'), lambda x: x <> '')[1:3], ' '))"
VK = f"""h AS (SELECT *, {_HEAD} AS head FROM t), vk AS (SELECT *, CASE {' '.join(f"WHEN regexp_matches(trim(description), '(?i){p}') THEN '{k}'" for p, k in X.PROCESSOR_ACTIONS)} {' '.join(f"WHEN regexp_matches(head, '(?i){p}') THEN '{k}'" for p, k in X.VENDOR_ALIASES)}
 ELSE array_to_string(list_filter(string_split(regexp_replace(head, '[^a-z0-9]+', '_', 'g'), '_'), lambda x: x <> '')[1:2], '_') END AS vendor_key FROM h)"""
_BUCKET = "CASE " + " ".join("WHEN category = '" + c.replace("'", "''") + f"' THEN '{b}'" for c, _, _, b, *_ in X.TAXONOMY if b) + " " + " ".join("WHEN " + " OR ".join(f"contains({NORM}, '{w}')" for w in ws) + f" THEN '{b}'" for ws, b, *_ in X.BUCKET_RULES) + " ELSE 'other_operating' END"
_G, _H = GM("coalesce(tax_gst, '')"), GM("coalesce(tax_hst, '')")
_STMT = """s AS (SELECT user_id, source_file, substr(date_posted, 1, 7) AS month, id, date_posted, abs(CAST(amount AS DECIMAL(18,2))) AS value, description, CASE WHEN transaction_type = 'CREDIT' THEN 1 ELSE -1 END * abs(CAST(amount AS DECIMAL(18,2))) AS signed FROM t),
 b AS (SELECT *, sum(signed) OVER w + CASE WHEN id % 23 = 0 THEN 1.00 ELSE 0.00 END AS balance FROM s WINDOW w AS (PARTITION BY user_id, source_file, month ORDER BY date_posted, id))"""
ORACLES |= {
    "vendor_key": with_views("t", f", {VK} SELECT user_id, id, vendor_key FROM vk"),
    "vendor_clusters": with_views("t", f""", {VK}, p AS (SELECT user_id, vendor_key, currency, count(*) AS n, CAST(sum({ABS}) AS {M}) AS total, min(date_posted) AS a, max(date_posted) AS z FROM vk GROUP BY ALL),
 q AS (SELECT user_id, vendor_key, array_to_string(list_sort(list(DISTINCT description))[1:5], ';') AS samples FROM vk GROUP BY ALL)
 SELECT p.user_id, p.vendor_key, CAST(sum(n) AS BIGINT) AS n, string_agg(currency || '=' || CAST(total AS VARCHAR), ';' ORDER BY currency) AS totals, min(a) AS first_date, max(z) AS last_date, any_value(samples) AS samples FROM p JOIN q ON q.user_id = p.user_id AND q.vendor_key = p.vendor_key GROUP BY p.user_id, p.vendor_key"""),
    "category_buckets": with_views("t", f"SELECT user_id, id, {_BUCKET} AS bucket FROM t"),
    "resolved_currency": with_views("r", f""", x AS (SELECT *, ({_G} + {_H}) <> 0 AS sig FROM r) SELECT user_id, id, CASE WHEN currency_source = 'stated' AND currency IS NOT NULL THEN currency WHEN sig THEN 'CAD' END AS resolved,
 CASE WHEN currency_source = 'stated' AND currency IS NOT NULL THEN 'stated' WHEN sig THEN 'inferred' ELSE 'assumed' END AS resolved_source FROM x"""),
    "checklist_state": with_views("trml", f""", u AS (SELECT user_id, count(*) AS transactions FROM t GROUP BY user_id), z AS (SELECT u.user_id, u.transactions, (SELECT count(*) FROM r WHERE r.user_id = u.user_id) AS receipts, (SELECT count(*) FROM m WHERE m.user_id = u.user_id AND m.status IN {PROOF}) AS matches,
 (SELECT count(*) FROM l WHERE l.user_id = u.user_id AND l.status <> 'USER_REJECTED') AS links FROM u)
 SELECT *, transactions > 0 AS has_transactions, receipts > 0 AS has_receipts, matches > 0 AS has_matches, links > 0 AS has_links, CAST(25.0 * ((transactions > 0)::INT + (receipts > 0)::INT + (matches > 0)::INT + (links > 0)::INT) AS DOUBLE) AS percent FROM z"""),
    "bucket_rollup": with_views("tl", f""", {OWN}, {TAXO}, {FXT}, p AS (SELECT o.user_id, tax.bucket, o.category, sum(CAST(v * rate AS DECIMAL(24,6))) AS v, max(scrutiny) AS scrutiny FROM o JOIN tax ON tax.category = o.category JOIN fx ON fx.currency = o.currency WHERE {EXP} GROUP BY ALL)
 SELECT user_id, bucket, CAST(sum(v) AS {M}) AS amount, CAST(max(scrutiny) AS DOUBLE) AS scrutiny, arg_max(category, (v, category)) AS primary_category FROM p GROUP BY ALL"""),
    "status_repair": with_views("tml", f""", {ENDS}, g AS (SELECT user_id, transaction_id AS id, bool_or(status IN {PROOF}) AS a, bool_or(status <> 'USER_REJECTED') AS o FROM m GROUP BY ALL),
 x AS (SELECT t.user_id, t.id, t.status, coalesce(g.a, false) AS a, coalesce(g.o, false) AS o, ends.id IS NOT NULL AS k FROM t LEFT JOIN g ON g.user_id = t.user_id AND g.id = t.id LEFT JOIN ends ON ends.user_id = t.user_id AND ends.id = t.id),
 y AS (SELECT *, CASE WHEN status = 'MATCHED' AND NOT o THEN CASE WHEN k THEN 'LINKED' ELSE 'UNMATCHED' END ELSE status END AS s1 FROM x), z AS (SELECT *, CASE WHEN s1 = 'LINKED' AND NOT k THEN 'UNMATCHED' ELSE s1 END AS s2 FROM y),
 w AS (SELECT *, CASE WHEN s2 = 'UNMATCHED' AND a THEN 'MATCHED' ELSE s2 END AS s3 FROM z), v AS (SELECT *, CASE WHEN s3 = 'UNMATCHED' AND k THEN 'LINKED' ELSE s3 END AS repaired FROM w) SELECT user_id, id, status, repaired FROM v WHERE status <> repaired"""),
    "statement_balance_check": with_views("t", f""", {_STMT}, c AS (SELECT *, count(*) OVER (PARTITION BY user_id, source_file, month, date_posted, value, substr(description, 1, 40)) > 1 AS again FROM b),
 g AS (SELECT user_id, source_file, month, count(*) AS n, CAST(sum(signed) AS {M}) AS expected, CAST(arg_max(balance, (date_posted, id)) AS {M}) AS closing, bool_or(again) AS duplicates FROM c GROUP BY ALL)
 SELECT *, concat_ws(',', CASE WHEN abs(expected - closing) > 0.02 THEN 'balance_mismatch' END, CASE WHEN duplicates THEN 'possible_duplicates' END, CASE WHEN n < 3 THEN 'few_rows' END) AS flags,
 CASE WHEN abs(expected - closing) > 0.02 THEN 'LOW' WHEN duplicates OR n < 3 THEN 'MEDIUM' ELSE 'HIGH' END AS tier FROM g"""),
    "ledger_export": with_views("trml", f""", {ENDS}, {TAXO}, p AS (SELECT m.user_id, m.transaction_id AS id, min(r.original_filename) AS file FROM m JOIN r ON r.user_id = m.user_id AND r.id = m.document_id WHERE m.status IN {PROOF} GROUP BY ALL)
 SELECT CAST(replace(t.date_posted, '-', '') AS INT) AS date, t.account, t.transaction_type, CASE WHEN {INC} THEN 1 ELSE -1 END * abs(CAST(t.amount AS {M})) AS amount, t.currency, t.description, t.category, tax.gifi,
 coalesce(p.file, CASE WHEN ends.id IS NOT NULL THEN 'Linked (see Transfers sheet)' END, '') AS proof FROM t LEFT JOIN tax ON tax.category = t.category LEFT JOIN p ON p.user_id = t.user_id AND p.id = t.id LEFT JOIN ends ON ends.user_id = t.user_id AND ends.id = t.id WHERE t.status <> 'EXCLUDED'"""),
}

# overview
_ALT = "CASE WHEN r.id % 10 = 3 THEN CAST(CAST(r.total AS DECIMAL(14,2)) * CAST(1.37 AS DECIMAL(3,2)) AS DECIMAL(14,2)) END"
_NAIVE_ALT = (
    NAIVE.replace("THEN r.currency END AS c,", f"THEN r.currency END AS c, {_ALT} AS alt,", 1)
    .replace(" WHEN coalesce(c, currency) <> currency AND", " WHEN alt <> d AND abs(a - alt) <= 2 THEN 'alt_amount'\n WHEN coalesce(c, currency) <> currency AND", 1)
    .replace("a BETWEEN d * 0.5 - 30 AND d * 2 + 30", "(a BETWEEN d * 0.5 - 30 AND d * 2 + 30 OR (alt <> d AND a BETWEEN alt * 0.5 - 30 AND alt * 2 + 30))", 1)
)
ORACLES["receipt_candidates_alternate"] = with_views("tr", f", {_NAIVE_ALT} SELECT user_id, transaction_id, document_id, match_reason, gap FROM cand WHERE match_reason IS NOT NULL")
_OWN = "CASE WHEN coalesce(c, currency) = currency THEN CASE WHEN a = d THEN 1.0 WHEN abs(a - d) <= 0.05 THEN 0.9 WHEN abs(a - d) <= 2 THEN 0.8 WHEN abs(a - d) <= 25 THEN 0.65 ELSE 0.0 END WHEN match_reason = 'fx_band' THEN 0.78 ELSE 0.0 END"
_SECOND = "CASE WHEN alt IS NULL OR alt = d THEN 0.0 WHEN a = alt THEN 0.95 WHEN abs(a - alt) <= 0.05 THEN 0.9 WHEN abs(a - alt) <= 2 THEN 0.8 WHEN abs(a - alt) <= 25 THEN 0.65 ELSE 0.0 END"
ORACLES["amount_scores_alternate"] = with_views("tr", f""", {_NAIVE_ALT} SELECT user_id, transaction_id, document_id, CAST(CASE WHEN {_OWN} > 0 THEN {_OWN} WHEN {_SECOND} > 0 THEN {_SECOND} WHEN coalesce(c, currency) = currency THEN 0.3 ELSE 0.0 END AS DOUBLE) AS amount_score FROM cand WHERE match_reason IS NOT NULL""")
# a vendor named by one of its words scores .80; no two names of the views are alike to that degree otherwise
ORACLES["unambiguous_settled"] = with_views("tr", f""", {NAIVE.replace("g <= 45", "g <= 100000").replace("r.id AS document_id,", "r.id AS document_id, r.vendor,", 1)},
 lone AS (SELECT user_id, document_id FROM cand WHERE match_reason IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
 SELECT cand.user_id, transaction_id, cand.document_id FROM cand JOIN lone ON lone.user_id = cand.user_id AND lone.document_id = cand.document_id
 WHERE match_reason IS NOT NULL AND c = currency AND abs(a - d) <= 0.02 AND gap <= 3 AND len(list_filter(regexp_extract_all(lower(vendor), '[a-z]{{3,}}'), lambda w : contains(lower(description), w))) > 0""")
_N = lambda s: f"count(*) FILTER (status = '{s}') AS {s.lower()}"
ORACLES["month_summary"] = with_views("t", f""", g AS (SELECT user_id, substr(date_posted, 1, 7) AS month, count(*) AS n, {_N("MATCHED")}, {_N("LINKED")}, {_N("UNMATCHED")}, {_N("IGNORED")} FROM t WHERE status <> 'EXCLUDED' GROUP BY ALL)
 SELECT *, CASE WHEN n > ignored THEN (matched + linked) * 100.0::DOUBLE / (n - ignored) ELSE 0.0 END AS documented FROM g""")
ORACLES["missing_proofs"] = with_views("tmr", f""", a AS (SELECT m.user_id, m.transaction_id AS id, r.id % 3 <> 0 AS there FROM m JOIN r ON r.user_id = m.user_id AND r.id = m.document_id WHERE m.status IN {PROOF}),
 g AS (SELECT user_id, id, bool_or(there) AS proved FROM a GROUP BY ALL)
 SELECT t.user_id, t.id, t.date_posted, CASE WHEN g.id IS NULL THEN 'no approved match on record' ELSE 'file is gone' END AS why FROM t LEFT JOIN g ON g.user_id = t.user_id AND g.id = t.id WHERE t.status = 'MATCHED' AND NOT coalesce(g.proved, false)""")
ORACLES["source_files_by_prefix"] = with_views("t", "SELECT DISTINCT user_id, source_file FROM t WHERE source_file LIKE 'stmt#_%' ESCAPE '#'")
ORACLES["action_items"] = with_views("tm", f""", a AS (SELECT user_id, 'pending_reviews' AS item FROM m WHERE status = 'PENDING_REVIEW' UNION ALL SELECT user_id, 'missing_receipts' FROM t WHERE status = 'UNMATCHED'
 UNION ALL SELECT user_id, 'wise_detected' FROM t WHERE status = 'UNMATCHED' AND regexp_matches(description, '(?i){"|".join(X.WISE_LINES)}')) SELECT user_id, item, count(*) AS n FROM a GROUP BY ALL""")
ORACLES["setup_completeness"] = with_views("trj", """, u AS (SELECT c_custkey AS user_id FROM customer WHERE c_custkey < 4 UNION SELECT user_id FROM t UNION SELECT user_id FROM r UNION SELECT user_id FROM j WHERE kind = 'statement' AND status = 'failed'),
 f AS (SELECT user_id, user_id IN (SELECT c_custkey FROM customer WHERE c_custkey < 4 AND trim(c_name) <> '') AS profile, user_id IN (SELECT user_id FROM t) AS bank_statement, user_id IN (SELECT user_id FROM r) AS receipt,
 user_id IN (SELECT user_id FROM t WHERE status = 'MATCHED') AS reconciliation, user_id IN (SELECT user_id FROM j WHERE kind = 'statement' AND status = 'failed') AS export FROM u)
 SELECT *, CAST(profile AS INT) + CAST(bank_statement AS INT) + CAST(receipt AS INT) + CAST(reconciliation AS INT) + CAST(export AS INT) AS done,
 CAST((CAST(profile AS INT) + CAST(bank_statement AS INT) + CAST(receipt AS INT) + CAST(reconciliation AS INT) + CAST(export AS INT)) * 20 AS INT) AS percent FROM f""")
_SETTLED = "(?i)" + "|".join(f"(?:{p})" for _, settled, ps in X.CATEGORY_RULES if settled for p in ps)
ORACLES["run_result"] = with_views("tm", f""", a AS (SELECT user_id, count(*) AS proposed, count(*) FILTER (status = 'AUTO_APPROVED') AS matched, count(*) FILTER (status = 'USER_APPROVED') AS refreshed, count(*) FILTER (status = 'PENDING_REVIEW') AS flagged, count(*) FILTER (status = 'USER_REJECTED') AS displaced FROM m GROUP BY ALL),
 b AS (SELECT user_id, count(*) FILTER (status = 'UNMATCHED' AND NOT regexp_matches(description, '{_SETTLED}')) AS reconcilable, count(*) FILTER (status IN ('MATCHED', 'LINKED')) AS x, count(*) FILTER (status IN ('MATCHED', 'LINKED', 'UNMATCHED')) AS y FROM t GROUP BY ALL)
 SELECT b.user_id, CASE WHEN coalesce(matched, 0) > 0 AND matched >= reconcilable THEN 'success' WHEN coalesce(matched, 0) > 0 THEN 'partial' WHEN reconcilable = 0 THEN 'nothing_to_reconcile' ELSE 'no_matches' END AS run_status,
 coalesce(matched, 0) AS matched, coalesce(refreshed, 0) AS refreshed, coalesce(flagged, 0) AS flagged, coalesce(displaced, 0) AS displaced, coalesce(proposed, 0) AS proposed, reconcilable,
 CASE WHEN y > 0 THEN round_even(x * 100.0::DOUBLE / y, 1) ELSE 0.0 END AS rate, reconcilable - coalesce(matched, 0) AS remaining FROM b LEFT JOIN a ON a.user_id = b.user_id""")
ORACLES["cost_summary"] = """WITH e AS (SELECT user_id % 4 AS user_id, event_type AS endpoint, CASE WHEN event_id % 3 = 0 THEN 'small' ELSE 'large' END AS model, CAST(value AS DECIMAL(18,6)) AS cost, event_id % 1000 AS i, event_id % 77 AS o FROM events WHERE ts >= TIMESTAMP '1990-01-01' AND ts < TIMESTAMP '2100-01-01')
 SELECT user_id, endpoint, model, CAST(grouping(endpoint) AS INT) AS is_total, CAST(coalesce(sum(cost), 0) AS DECIMAL(28,6)) AS cost, count(*) AS calls, CAST(coalesce(sum(i), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(o), 0) AS BIGINT) AS tokens_out FROM e GROUP BY GROUPING SETS ((user_id), (user_id, endpoint, model))"""
ORACLES["job_list"] = with_views("j", """, f AS (SELECT *, CASE WHEN status <> 'pending' THEN epoch(date_trunc('second', created_at)) + floor(seconds) ELSE epoch(created_at) END AS ended FROM j)
 SELECT user_id, CAST(row_number() OVER w AS INT) AS place, id, status FROM f
 WINDOW w AS (PARTITION BY user_id ORDER BY CASE WHEN status = 'pending' THEN 0 ELSE 1 END, CASE WHEN status = 'pending' THEN position END ASC NULLS FIRST, ended DESC, position DESC) QUALIFY row_number() OVER w <= 100""")
ORACLES["first_and_latest_by_hash"] = with_views("r", "SELECT user_id, file_hash, min(id) AS first_id, max_by(original_filename, id) AS latest_name, count(*) AS n FROM r WHERE file_hash <> '' GROUP BY ALL")
ORACLES["matched_file"] = with_views("mr", "SELECT m.user_id, m.transaction_id, min_by(r.original_filename, m.id) AS file FROM m JOIN r ON r.user_id = m.user_id AND r.id = m.document_id WHERE m.status <> 'USER_REJECTED' GROUP BY ALL")
ORACLES["linked_or_found_ids"] = with_views("lc", "SELECT user_id, source_transaction_id AS id FROM l WHERE status <> 'USER_REJECTED' UNION SELECT user_id, target_transaction_id FROM l WHERE status <> 'USER_REJECTED' UNION SELECT user_id, source_transaction_id FROM c UNION SELECT user_id, target_transaction_id FROM c")
ORACLES["deleted_partners"] = with_views("tl", """, x AS (SELECT user_id, id FROM t WHERE status = 'EXCLUDED') SELECT l.user_id, l.target_transaction_id AS id FROM l JOIN x ON x.user_id = l.user_id AND x.id = l.source_transaction_id
 UNION SELECT l.user_id, l.source_transaction_id FROM l JOIN x ON x.user_id = l.user_id AND x.id = l.target_transaction_id EXCEPT SELECT user_id, id FROM x""")
_LABEL = "CASE l.link_type " + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in X.LINK_LABELS.items()) + " ELSE l.link_type END"
_SIDE = lambda a: f"{a}.account || ' $' || CAST(abs(CAST({a}.amount AS {M})) AS VARCHAR) || ' ' || {a}.currency"
_APART = "abs(date_diff('day', CAST(a.date_posted AS DATE), CAST(b.date_posted AS DATE)))"
ORACLES["link_explanations"] = with_views("tl", f"""SELECT l.user_id, l.id, {_LABEL} || ': ' || {_SIDE("a")} || ' -> ' || {_SIDE("b")} || CASE WHEN {_APART} > 0 THEN ' (' || CAST({_APART} AS VARCHAR) || 'd apart)' ELSE '' END AS explanation
 FROM l JOIN t a ON a.user_id = l.user_id AND a.id = l.source_transaction_id JOIN t b ON b.user_id = l.user_id AND b.id = l.target_transaction_id""")
ORACLES["statement_rows_kept"] = with_views("t", f"SELECT user_id, id FROM t WHERE NOT regexp_full_match(trim(description), '(?i)({"|".join(X.SUMMARY_LINES)})')")
ORACLES["vendor_rule_category"] = with_views("t", """SELECT user_id, id, CASE WHEN regexp_matches(description, '(?i)amzn|amazon') THEN 'Office supplies' WHEN regexp_matches(description, '(?i)telecom') THEN 'Utilities and telephone/telecommunication' WHEN regexp_matches(description, '(?i)software') THEN 'Software and IT' ELSE 'Others' END AS rule_category,
 CASE WHEN regexp_matches(description, '(?i)amzn|amazon|telecom|software') THEN 'rule' ELSE 'default' END AS rule_source FROM t""")
_SPEND = ORACLES["bucket_rollup"]
ORACLES["naics_resolution"] = with_views("t", f""", spend AS (SELECT user_id AS u, bucket, CAST(amount AS DOUBLE) AS amount FROM ({_SPEND}) WHERE bucket NOT IN ('operating_revenue', 'distribution', 'transfer', 'non_operating')),
 s AS (SELECT u, coalesce(sum(amount) FILTER (bucket = 'cost_of_sales'), 0) / sum(amount) AS goods, coalesce(sum(amount) FILTER (bucket = 'subcontracts'), 0) / sum(amount) AS sub, coalesce(sum(amount) FILTER (bucket = 'it_software'), 0) / sum(amount) AS it, coalesce(sum(amount) FILTER (bucket = 'rent'), 0) / sum(amount) AS rent FROM spend GROUP BY u HAVING sum(amount) > 0),
 i AS (SELECT u, CASE WHEN goods > 0.30 AND rent > 0.03 THEN '7225' WHEN goods > 0.25 AND sub > 0.15 THEN '2361' WHEN goods < 0.15 AND (it > 0.04 OR sub > 0.15) THEN '5415' END AS code FROM s)
 SELECT p.user_id, CASE p.user_id WHEN 1 THEN '2382' WHEN 2 THEN '7225' ELSE i.code END AS naics, CASE WHEN p.user_id = 1 THEN 'profile' WHEN p.user_id = 2 THEN 'industry_map' WHEN i.code IS NOT NULL THEN 'data_inferred' END AS naics_source
 FROM (SELECT DISTINCT user_id FROM t) p LEFT JOIN i ON i.u = p.user_id""")
ORACLES["profitability_lines"] = with_views("tl", f""", {OWN}, {FXT}, amounts AS ({_SPEND}), revenue AS (SELECT o.user_id, CAST(sum(CAST(v * rate AS DECIMAL(24,6))) AS {M}) AS revenue FROM o JOIN fx ON fx.currency = o.currency WHERE {INC} GROUP BY o.user_id),
 best(bucket, pct) AS (VALUES ('travel', 0.04::DOUBLE), ('rent', 0.07::DOUBLE))
 SELECT a.user_id, a.bucket, round(CAST(amount AS DOUBLE) / CAST(revenue AS DOUBLE), 9) AS your_pct, pct AS peer_pct, CAST(row_number() OVER (PARTITION BY a.user_id ORDER BY CAST(amount AS DOUBLE) / CAST(revenue AS DOUBLE) DESC, a.bucket) AS INT) AS rank
 FROM amounts a JOIN revenue r ON r.user_id = a.user_id JOIN best ON best.bucket = a.bucket WHERE revenue > 0 AND (amount >= revenue * 0.02 OR amount >= 500)""")

# tax codes, peers and transfers
_PLACES = [*X.FOREIGN_COUNTRIES, "CAN"]
ORACLES["tax_codes"] = with_views("tmr", f""", {TAXO}, x AS (SELECT m.user_id, m.transaction_id AS id, sum({GM("coalesce(r.tax_gst, '')")}) + sum({GM("coalesce(r.tax_hst, '')")}) > 0 AS shows FROM m JOIN r ON r.user_id = m.user_id AND r.id = m.document_id WHERE m.status IN {PROOF} GROUP BY ALL),
 k AS (SELECT t.user_id, t.id, t.category, tax.kind, coalesce(x.shows, false) AS shows, x.id IS NOT NULL AS linked, list_filter(list_transform(regexp_extract_all(t.description, '[A-Za-z0-9$.]+'), lambda w: upper(regexp_replace(w, '^[.$]+|[.$]+$', '', 'g'))), lambda w: w <> '') AS w
  FROM t LEFT JOIN tax ON tax.category = t.category LEFT JOIN x ON x.user_id = t.user_id AND x.id = t.id),
 p AS (SELECT *, list_filter(w, lambda v: list_contains([{q(_PLACES)}], v))[1] AS country, w[-1] AS z FROM k),
 f AS (SELECT *, CASE WHEN len(w) = 0 OR country = 'CAN' THEN false WHEN country IS NOT NULL OR list_has_any(w, [{q(X.FOREIGN_REGIONS)}]) THEN true
  ELSE coalesce(CASE WHEN length(z) = 2 THEN z WHEN length(z) >= 5 AND regexp_full_match(z, '[A-Z]+') THEN right(z, 2) END IN ({q(x for x in X.US_STATES if x not in X.PROVINCES)}), false) END AS abroad FROM p),
 g AS (SELECT *, CASE WHEN kind IS NULL THEN CASE WHEN category IS NULL AND abroad THEN ['', 'uncategorized, non-resident'] ELSE ['', 'uncategorized'] END
  WHEN category = 'Owner''s draw' THEN ['BAS Excluded', 'owner distribution'] WHEN kind = 'transfer' THEN ['BAS Excluded', 'own accounts'] WHEN kind = 'tax' THEN ['BAS Excluded', 'remittance'] WHEN kind = 'equity' THEN ['BAS Excluded', 'owner distribution']
  WHEN kind = 'contra' THEN ['', 'refund follows the original supply']
  WHEN kind = 'income' THEN CASE WHEN shows THEN ['GST on Income', 'tax collected on the linked document'] WHEN abroad THEN ['Zero-rated / No GST', 'non-resident payer'] WHEN linked THEN ['', 'linked document shows no tax'] ELSE ['', 'no sales document linked'] END
  WHEN shows THEN ['GST on Expenses', 'tax on the linked document'] WHEN abroad THEN ['Zero-rated / No GST', 'non-resident supplier'] WHEN linked THEN ['', 'linked document shows no tax'] ELSE ['', 'no document linked'] END AS o FROM f)
 SELECT user_id, id, o[1] AS tax_code, o[2] AS tax_basis FROM g""")
ORACLES["peer_comparison"] = with_views("tl", f""", {OWN}, {FXT}, amounts AS ({_SPEND}), revenue AS (SELECT o.user_id, CAST(sum(CAST(v * rate AS DECIMAL(24,6))) AS {M}) AS revenue FROM o JOIN fx ON fx.currency = o.currency WHERE {INC} GROUP BY o.user_id),
 cell(bucket, q1, mid, q3) AS (VALUES ('travel', 0.01::DOUBLE, 0.05::DOUBLE, 0.10::DOUBLE), ('rent', 0.02::DOUBLE, 0.06::DOUBLE, 0.12::DOUBLE), ('insurance', 0.20::DOUBLE, 0.30::DOUBLE, 0.40::DOUBLE), ('office_supplies', 0.01::DOUBLE, 0.01::DOUBLE, 0.01::DOUBLE)),
 x AS (SELECT a.user_id, a.bucket, scrutiny, q1, mid, q3, CAST(amount AS DOUBLE) / CAST(revenue AS DOUBLE) AS s FROM amounts a JOIN revenue r ON r.user_id = a.user_id LEFT JOIN cell ON cell.bucket = a.bucket WHERE revenue > 0),
 y AS (SELECT *, CASE WHEN q1 <= mid AND mid <= q3 AND q3 > q1 THEN CASE WHEN s > q3 + 1.5::DOUBLE * (q3 - q1) THEN 'far_above' WHEN s > q3 THEN 'above' WHEN s < q1 - 1.5::DOUBLE * (q3 - q1) THEN 'far_below' WHEN s < q1 THEN 'below' ELSE 'within' END
  WHEN mid IS NOT NULL THEN CASE WHEN s > mid * 1.15::DOUBLE THEN 'above' WHEN s < mid * 0.85::DOUBLE THEN 'below' ELSE 'within' END ELSE 'no_data' END AS status FROM x),
 z AS (SELECT *, CASE WHEN status LIKE 'far%' THEN 2.0::DOUBLE WHEN status IN ('above', 'below') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END * scrutiny AS weight FROM y)
 SELECT user_id, bucket, round(s, 9) AS ratio, status, weight, CAST(row_number() OVER (PARTITION BY user_id ORDER BY weight DESC, bucket) AS INT) AS rank FROM z""")
_WORDS = "list_filter([" + ", ".join(f"CASE WHEN account IN ({q(accounts)}) AND regexp_matches(description, '(?i){p}') THEN {{'kind': '{kind}', 'side': '{side}', 'n': {n}}} END" for p, kind, side, accounts, n in X.TRANSFER_KEYWORDS) + "], lambda e: e IS NOT NULL)"
_RATE = lambda p: f"CASE WHEN TRY_CAST(regexp_extract(description, '{p}', 1) AS DOUBLE) > 0.5 AND TRY_CAST(regexp_extract(description, '{p}', 1) AS DOUBLE) < 3.0 THEN TRY_CAST(regexp_extract(description, '{p}', 1) AS DOUBLE) END"
_TIERS = lambda k: "CASE " + " ".join(f"WHEN gap <= {d} THEN {v}::DOUBLE" for d, v in X.DATE_TIERS[k]) + " ELSE 0.0::DOUBLE END"
_PAIRS = {k: sorted({"|".join(sorted(p)) for p in ps}) for k, ps in X.VALID_ACCOUNT_PAIRS.items()}
_BEST = lambda xs: f"list_filter({xs}, lambda e: e['n'] = list_max(list_transform({xs}, lambda h: h['n'])))[1]['kind']"
ORACLES["transfer_pairs_scored"] = with_views("t", f""", w AS (SELECT user_id, id, account, currency, transaction_type AS ty, CAST(date_posted AS DATE) AS day, {ABS} AS v, coalesce({_RATE("AT([0-9]+[.][0-9]{2,6})")}, {_RATE("@([0-9]+[.][0-9]{2,10})")}) AS rate, {_WORDS} AS ws,
  {NORM} IN ({q(X.TRANSFER_CATEGORY_KEYS)}) OR coalesce(category IN ({q(KINDS)}), false) AS says FROM t),
 s AS (SELECT * FROM w WHERE says OR len(ws) > 0),
 p AS (SELECT a.user_id, a.id AS a_id, b.id AS b_id, a.ty AS a_ty, a.v AS x, b.v AS y, a.currency AS cx, b.currency AS cy, coalesce(a.rate, b.rate) AS rate, date_diff('day', a.day, b.day) AS gap, least(a.account, b.account) || '|' || greatest(a.account, b.account) AS accounts, a.ws AS aw, b.ws AS bw
  FROM s a JOIN s b ON a.user_id = b.user_id AND a.account <> b.account AND a.ty <> b.ty AND (a.day < b.day OR (a.day = b.day AND a.id < b.id)) AND b.day <= a.day + {max(X.DATE_WINDOWS.values())}),
 e AS (SELECT *, CASE WHEN y > 0 THEN abs(CASE WHEN cx = 'CAD' AND cy = 'USD' THEN CAST(x AS DOUBLE) / rate WHEN cx = 'USD' AND cy = 'CAD' THEN CAST(x AS DOUBLE) * rate END - CAST(y AS DOUBLE)) / CAST(y AS DOUBLE) END AS pct FROM p),
 m1 AS (SELECT *, CAST(CASE WHEN cx = cy THEN CASE WHEN x = y THEN 1.0 WHEN abs(x - y) <= 0.01 THEN 0.98 WHEN abs(x - y) <= 0.50 THEN 0.85 WHEN abs(x - y) <= 2 THEN 0.60 ELSE 0.0 END WHEN pct <= 0.005::DOUBLE THEN 0.95 WHEN pct <= 0.02::DOUBLE THEN 0.80
  WHEN ((cx = 'CAD' AND cy = 'USD') OR (cx = 'USD' AND cy = 'CAD')) AND greatest(x, y) >= least(x, y) * {X.FX_MIN} AND greatest(x, y) <= least(x, y) * {X.FX_MAX} AND least(x, y) > 0 THEN 0.78 ELSE 0.0 END AS DOUBLE) AS am FROM e),
 m2 AS (SELECT *, flatten(list_transform(aw, lambda g: list_transform(list_filter(bw, lambda h: h['kind'] = g['kind'] AND h['side'] <> g['side']), lambda h: {{'n': g['n'] + h['n'], 'kind': g['kind']}}))) AS both_sides, list_concat(aw, bw) AS one_side FROM m1 WHERE am > 0),
 m3 AS (SELECT *, CASE WHEN len(both_sides) > 0 THEN {_BEST("both_sides")} WHEN len(one_side) > 0 THEN {_BEST("one_side")} ELSE 'OTHER' END AS link_type, CAST(CASE WHEN len(both_sides) > 0 THEN 1.0 WHEN len(one_side) > 0 THEN 0.60 ELSE 0.15 END AS DOUBLE) AS kw FROM m2),
 m4 AS (SELECT *, CASE {" ".join(f"WHEN link_type = '{k}' THEN {_TIERS(k)}" for k in X.DATE_TIERS)} ELSE {_TIERS("INTERNAL_TRANSFER")} END AS da,
  CAST(CASE WHEN {" OR ".join(f"(link_type = '{k}' AND accounts IN ({q(ps)}))" for k, ps in _PAIRS.items() if ps)} THEN 1.0 WHEN accounts IN ({q(sorted({p for ps in _PAIRS.values() for p in ps}))}) THEN 0.50 ELSE 0.0 END AS DOUBLE) AS ac FROM m3),
 m5 AS (SELECT *, 0.45::DOUBLE * am + 0.25::DOUBLE * da + 0.20::DOUBLE * kw + 0.10::DOUBLE * ac AS base FROM m4),
 m6 AS (SELECT *, CASE WHEN link_type IN ({q(X.CERTAIN_LINK_TYPES)}) AND am = 1 AND kw = 1 AND ac = 1 THEN greatest(base, 0.92::DOUBLE) WHEN cx = cy AND am < 1 THEN least(base, 0.85::DOUBLE) ELSE base END AS score FROM m5
  WHERE base >= 0.55::DOUBLE AND gap <= CASE link_type {" ".join(f"WHEN '{k}' THEN {d}" for k, d in X.DATE_WINDOWS.items())} END)
 SELECT user_id, CASE WHEN a_ty = 'DEBIT' THEN a_id ELSE b_id END AS source_id, CASE WHEN a_ty = 'DEBIT' THEN b_id ELSE a_id END AS target_id, link_type, am AS amount_score, da AS date_score, kw AS keyword_score, ac AS account_score, round(score, 9) AS score,
 CASE WHEN score >= 0.92::DOUBLE THEN 'AUTO_APPROVED' ELSE 'PENDING_REVIEW' END AS status FROM m6""")

# statements as text
_MON = "(position(lower(substr({}, 1, 3)) IN 'janfebmaraprmayjunjulaugsepoctnovdec') + 2) // 3"
_LINE = r"^([A-Z][a-z]{2})(\d{2})\s+(.+?)\s+(-?[\d,]+\.\d{2})(?:\s+(-?[\d,]+\.\d{2}))?(?:\s+(-?[\d,]+\.\d{2}))?\s*$"
_AT = lambda k: f"regexp_extract(line, '{_LINE}', {k})"
ORACLES["balance_typed_rows"] = with_views(["sl"], f"""
, f AS (SELECT file, CAST(regexp_extract(line, 'ending [A-Z][a-z]+ [0-9]+, ([0-9]+)', 1) AS INT) AS year, {_MON.format("regexp_extract(line, 'ending ([A-Z][a-z]+)', 1)")} AS month FROM sl WHERE row = 0),
 p AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY row) - 1 AS row, {_AT(1)} AS mon, {_AT(2)} AS dd, {_AT(3)} AS said, list_filter([{_AT(4)}, {_AT(5)}, {_AT(6)}], lambda x: x <> '') AS a FROM sl WHERE regexp_matches(line, '{_LINE}')),
 q AS (SELECT *, replace(lower(said), ' ', '') AS bare, replace(lower(said), ' ', '') LIKE '%openingbalance%' AS opening, NOT regexp_matches(replace(lower(said), ' ', ''), 'openingbalance|closingtotals|closingbalance|numberofitems') AND len(a) >= 2 AS fits FROM p),
 b AS (SELECT *, CASE WHEN opening OR fits THEN CAST(a[-1] AS {M}) END AS balance FROM q),
 c AS (SELECT *, last_value(balance IGNORE NULLS) OVER (PARTITION BY file ORDER BY row ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
 d AS (SELECT *, CASE WHEN len(a) = 3 THEN false WHEN before IS NOT NULL THEN balance > before ELSE regexp_matches(upper(said), 'INCOMING|DEPOSIT|INTEREST|CREDIT|REFUND') END AS came FROM c WHERE fits)
 SELECT d.file AS source_file, row AS source_row, strftime(make_date(CASE WHEN {_MON.format("mon")} > f.month THEN f.year - 1 ELSE f.year END, {_MON.format("mon")}, CAST(dd AS INT)), '%Y-%m-%d') AS date_posted, CASE WHEN came THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
 CAST(CASE WHEN came THEN CAST(a[1] AS {M}) ELSE -CAST(a[1] AS {M}) END AS VARCHAR) AS amount, regexp_replace(said, ',+$', '') AS description FROM d JOIN f ON f.file = d.file""")
_ORDER = """o AS (SELECT file, coalesce(arg_min(CASE WHEN CAST(split_part(dd, '/', 1) AS INT) > 12 THEN 'dmy' ELSE 'mdy' END, page * 1000000000 + n * 100000000 + id) FILTER (CAST(split_part(dd, '/', 1) AS INT) > 12 OR CAST(split_part(dd, '/', 2) AS INT) > 12), 'dmy') AS date_order FROM wp GROUP BY file)"""
ORACLES["wallet_page_rows"] = with_views(["wp"], f"""
, {_ORDER}, g AS (SELECT file, page, any_value(CASE heads WHEN '' THEN [] ELSE string_split(heads, ',') END) AS s, list(DISTINCT n ORDER BY n) AS ns FROM wp GROUP BY file, page),
 h AS (SELECT *, last_value(CASE WHEN len(s) > 0 THEN s[least(len(ns), len(s) - 1) + 1] END IGNORE NULLS) OVER (PARTITION BY file ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carried FROM g),
 r AS (SELECT wp.*, CASE WHEN len(s) > 0 THEN s[least(list_position(ns, n) - 1, len(s) - 1) + 1] ELSE coalesce(carried, 'CAD') END AS currency, make_date(CAST(yyyy AS INT), CAST(split_part(dd, '/', CASE date_order WHEN 'dmy' THEN 2 ELSE 1 END) AS INT), CAST(split_part(dd, '/', CASE date_order WHEN 'dmy' THEN 1 ELSE 2 END) AS INT)) AS d FROM wp JOIN h ON h.file = wp.file AND h.page = wp.page JOIN o ON o.file = wp.file),
 x AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY page, n, id) AS row FROM r)
 SELECT file AS source_file, row AS source_row, strftime(d, '%Y-%m-%d') AS date_posted, CASE WHEN CAST(gross AS {M}) < 0 THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type, gross AS amount, currency, 'Someone — ' || said AS description FROM x WHERE said <> 'General Currency Conversion' AND CAST(gross AS {M}) <> 0""")
ORACLES["statement_facts"] = with_views(["sl", "wp"], f"""
, {_ORDER} SELECT file, 'CAD' AS account, false AS is_wallet, 'dmy' AS date_order, true AS is_business, CAST(regexp_extract(line, 'ending [A-Z][a-z]+ [0-9]+, ([0-9]+)', 1) AS INT) AS year, CAST({_MON.format("regexp_extract(line, 'ending ([A-Z][a-z]+)', 1)")} AS INT) AS month, CAST(regexp_extract(line, 'ending [A-Z][a-z]+ [0-9]+, ([0-9]+)', 1) AS INT) AS from_year FROM sl WHERE row = 0
 UNION ALL SELECT wp.file, 'CAD', true, any_value(date_order), false, CASE WHEN bool_or(heads = '') THEN any_value(CAST(yyyy AS INT)) ELSE 2000 END, 12, CASE WHEN bool_or(heads = '') THEN any_value(CAST(yyyy AS INT)) ELSE 2000 END FROM wp JOIN o ON o.file = wp.file GROUP BY wp.file""")
_RAILS = r"WISEMSP|WISE\s*MSP|WISE\s*PAYMENTS|PAYPALMSP|PAYPAL\s*MSP|OUTGOING\s*WIRE"
_ROUND = ORACLES["receipt_first_round"].split(NAIVE, 1)[1].rsplit("SELECT user_id, transaction_id, document_id FROM b", 1)
ORACLES["crossed_payments"] = with_views("tr", "").rstrip().replace("t AS (", "t0 AS (", 1).rstrip() + f""",
 t AS (SELECT * REPLACE (CASE WHEN id % 3 = 2 THEN 'WISE PAYMENTS 884120' ELSE description END AS description) FROM t0), {NAIVE}{_ROUND[0]},
 asg AS (SELECT user_id, transaction_id, document_id, gap FROM b {_ROUND[1]}),
 far AS (SELECT asg.user_id, asg.document_id, asg.gap AS was FROM asg JOIN t ON t.user_id = asg.user_id AND t.id = asg.transaction_id WHERE asg.gap BETWEEN 31 AND 999999 AND regexp_matches(t.description, '(?i){_RAILS}')),
 ask AS (SELECT z.user_id, z.document_id, z.transaction_id, z.gap FROM z JOIN far ON far.user_id = z.user_id AND far.document_id = z.document_id AND z.gap < far.was WHERE NOT EXISTS (SELECT 1 FROM asg WHERE asg.user_id = z.user_id AND asg.transaction_id = z.transaction_id) QUALIFY row_number() OVER (PARTITION BY z.user_id, z.document_id ORDER BY z.gap, z.transaction_id) = 1),
 mv AS (SELECT * FROM ask QUALIFY row_number() OVER (PARTITION BY user_id, transaction_id ORDER BY gap, document_id) = 1),
 now AS (SELECT asg.user_id, coalesce(mv.transaction_id, asg.transaction_id) AS transaction_id, asg.document_id, mv.transaction_id IS NOT NULL AS moved FROM asg LEFT JOIN mv ON mv.user_id = asg.user_id AND mv.document_id = asg.document_id),
 rail AS (SELECT user_id, id AS transaction_id, CAST(date_posted AS DATE) AS day, abs(CAST(amount AS {M})) AS size FROM t WHERE status = 'UNMATCHED' AND transaction_type = 'DEBIT' AND regexp_matches(description, '(?i){_RAILS}')),
 mt AS (SELECT now.*, day, size FROM now JOIN rail ON rail.user_id = now.user_id AND rail.transaction_id = now.transaction_id),
 anc AS (SELECT user_id, min(day) AS anchor FROM mt GROUP BY user_id UNION ALL SELECT anc.user_id, (SELECT min(day) FROM mt WHERE mt.user_id = anc.user_id AND mt.day > anc.anchor + 2) FROM anc WHERE anchor IS NOT NULL),
 big AS (SELECT anc.user_id, anchor FROM anc JOIN mt ON mt.user_id = anc.user_id AND mt.day BETWEEN anchor AND anchor + 2 GROUP BY ALL HAVING count(*) >= 2),
 hd AS (SELECT mt.*, anchor FROM mt JOIN big ON big.user_id = mt.user_id AND mt.day BETWEEN anchor AND anchor + 2),
 ex AS (SELECT r.user_id, r.transaction_id, r.size, min(big.anchor) AS anchor FROM rail r JOIN big ON big.user_id = r.user_id AND abs(date_diff('day', r.day, big.anchor)) <= 2 WHERE NOT EXISTS (SELECT 1 FROM now WHERE now.user_id = r.user_id AND now.transaction_id = r.transaction_id)
  AND EXISTS (SELECT 1 FROM z JOIN hd ON hd.user_id = z.user_id AND hd.document_id = z.document_id WHERE hd.anchor = big.anchor AND z.user_id = r.user_id AND z.transaction_id = r.transaction_id) GROUP BY ALL),
 pool AS (SELECT user_id, anchor, transaction_id, row_number() OVER (PARTITION BY user_id, anchor ORDER BY size DESC, free, transaction_id) AS place FROM (SELECT user_id, anchor, transaction_id, size, 0 AS free FROM hd UNION ALL SELECT user_id, anchor, transaction_id, size, 1 FROM ex)),
 ds AS (SELECT hd.user_id, hd.anchor, hd.document_id, hd.transaction_id AS old, row_number() OVER (PARTITION BY hd.user_id, hd.anchor ORDER BY coalesce(abs(TRY_CAST(r.total AS {M})), 0) DESC, hd.document_id) AS place FROM hd JOIN r ON r.user_id = hd.user_id AND r.id = hd.document_id),
 rk AS (SELECT ds.*, pool.transaction_id AS t2, EXISTS (SELECT 1 FROM z WHERE z.user_id = ds.user_id AND z.transaction_id = pool.transaction_id AND z.document_id = ds.document_id) AS known FROM ds JOIN pool ON pool.user_id = ds.user_id AND pool.anchor = ds.anchor AND pool.place = ds.place),
 ok AS (SELECT user_id, anchor, bool_and(known) AND bool_or(t2 <> old) AS take FROM rk GROUP BY ALL),
 fin AS (SELECT rk.user_id, rk.document_id, rk.anchor, CASE WHEN take THEN t2 END AS t2 FROM rk JOIN ok ON ok.user_id = rk.user_id AND ok.anchor = rk.anchor)
 SELECT now.user_id, coalesce(fin.t2, now.transaction_id) AS transaction_id, now.document_id, strftime(fin.anchor, '%Y-%m-%d') AS anchor, CASE WHEN fin.t2 <> now.transaction_id THEN 'reassigned' WHEN moved THEN 'moved closer' ELSE 'kept' END AS outcome
 FROM now LEFT JOIN fin ON fin.user_id = now.user_id AND fin.document_id = now.document_id"""
ORACLES["crossed_payments"] = ORACLES["crossed_payments"].replace("WITH t0", "WITH RECURSIVE t0", 1)

# page batches, sheets, quotes, counts, review actions, cube
_BLANK = lambda c: f"coalesce(lower(trim({c})) IN ('', 'null', 'none', 'n/a'), true)"
_FIG = "coalesce(TRY_CAST(nullif(trim(regexp_replace(regexp_replace(trim(raw), '[$, ]', '', 'g'), '[A-Za-z]+$', '')), '') AS DECIMAL(18,2)), 0)"
_FIRST = lambda f, more="": f"arg_min({f}, CASE WHEN continuation = 'true' THEN 1000 ELSE 0 END + batch) FILTER (NOT {_BLANK(f)}{more}) AS {f}"
ORACLES["page_batches_merged"] = with_views(["pb"], f""", a AS (SELECT *, CASE WHEN {_BLANK("total")} THEN amount ELSE total END AS raw FROM pb), b AS (SELECT *, {_FIG} AS fig FROM a),
 c AS (SELECT *, CASE WHEN fig <> 0 THEN CASE WHEN grand_total_page IS NOT NULL THEN CAST(grand_total_page AS INT) WHEN has_grand_total IS NOT NULL THEN last_page END END AS page FROM b),
 d AS (SELECT *, page * 1000 + batch AS place FROM c),
 g AS (SELECT user_id, document_id, {_FIRST("vendor", " AND vendor <> 'NOT_A_FINANCIAL_DOCUMENT'")}, bool_or(coalesce(vendor = 'NOT_A_FINANCIAL_DOCUMENT', false)) AS nf, {_FIRST("currency")}, {_FIRST("invoice_number")},
  arg_max(raw, place) FILTER (page IS NOT NULL) AS claim, arg_max(CASE WHEN NOT {_BLANK("gst")} THEN gst ELSE '-' END, place) FILTER (page IS NOT NULL) AS claim_gst, arg_max(CASE WHEN NOT {_BLANK("amount")} THEN amount ELSE '-' END, place) FILTER (page IS NOT NULL) AS claim_amount,
  arg_max(raw, batch) FILTER (fig <> 0) AS back, arg_max(CASE WHEN NOT {_BLANK("gst")} THEN gst ELSE '-' END, batch) FILTER (fig <> 0) AS back_gst, arg_max(CASE WHEN NOT {_BLANK("amount")} THEN amount ELSE '-' END, batch) FILTER (fig <> 0) AS back_amount,
  arg_min(gst, batch) FILTER (NOT {_BLANK("gst")}) AS any_gst, arg_min(amount, batch) FILTER (NOT {_BLANK("amount")}) AS any_amount, arg_min(fig, place) FILTER (page IS NOT NULL) AS f0, max(fig) FILTER (page IS NOT NULL) AS hi, min(fig) FILTER (page IS NOT NULL) AS lo, count(page) AS n_claims, count(*) AS n_batches,
  string_agg('{{"description":"' || item || '"}};{{"description":"tax"}}', ';' ORDER BY batch) AS line_items, bool_or(weak IS NOT NULL) AS weak FROM d GROUP BY user_id, document_id)
 SELECT user_id, document_id, coalesce(vendor, CASE WHEN nf THEN 'NOT_A_FINANCIAL_DOCUMENT' END) AS vendor, currency, invoice_number, coalesce(claim, back) AS total, coalesce(nullif(coalesce(claim_gst, back_gst), '-'), any_gst) AS gst, coalesce(nullif(coalesce(claim_amount, back_amount), '-'), any_amount) AS amount, line_items, CAST(n_claims AS INT) AS n_claims, n_batches,
 array_to_string(list_filter([CASE WHEN hi - f0 > 0.02 OR f0 - lo > 0.02 THEN 'totals_disagree' END, CASE WHEN claim IS NULL AND back IS NULL THEN 'no_amount' WHEN claim IS NULL THEN 'no_grand_total' END, CASE WHEN document_id % 9 = 0 THEN 'pages_left_out' END, CASE WHEN weak THEN 'low_confidence' END], lambda x: x IS NOT NULL), ',') AS reasons FROM g""")
_YMD = lambda c: f"CASE WHEN regexp_matches({c}, '^[0-9]{{8}}') THEN concat(substr({c}, 1, 4), '-', substr({c}, 5, 2), '-', substr({c}, 7, 2)) END"
ORACLES["workbook_rows"] = with_views(["bs"], f""", x AS (SELECT *, CASE WHEN sec = 1 THEN c1 ELSE c2 END AS ymd, CASE sec WHEN 1 THEN c2 ELSE c1 END AS typ, CASE WHEN sec = 2 THEN c4 ELSE c3 END AS money, CASE WHEN sec = 2 THEN c3 ELSE c4 END AS said FROM bs WHERE kind = 1),
 y AS (SELECT *, CASE WHEN money LIKE '% CR' THEN -CAST(replace(replace(money, ' CR', ''), '$', '') AS {M}) ELSE CAST(money AS {M}) END AS v FROM x)
 SELECT CASE sec WHEN 1 THEN 'CAD' WHEN 2 THEN 'USD' ELSE 'CreditCard' END AS account, CASE WHEN sec = 3 THEN CASE WHEN v < 0 THEN 'CREDIT' ELSE 'DEBIT' END ELSE coalesce(upper(typ), CASE WHEN v < 0 THEN 'DEBIT' ELSE 'CREDIT' END) END AS transaction_type, {_YMD("ymd")} AS date_posted, CAST(v AS VARCHAR) AS amount, said AS description,
 CASE trim(coalesce(c5, '')) WHEN 'Bank fees' THEN 'Interest and bank charges' WHEN 'office supplies' THEN 'Office supplies' ELSE trim(coalesce(c5, '')) END AS category, '' AS invoice, '' AS note, file, sheet, row FROM y WHERE {_YMD("ymd")} IS NOT NULL""")
ORACLES["converted_by_day"] = with_views(["t", "fx"], f""", x AS (SELECT user_id, id, CASE id % 7 WHEN 3 THEN 'EUR' WHEN 5 THEN 'GBP' ELSE currency END AS currency, CAST(date_posted AS DATE) AS day, {ABS} AS v FROM t)
 SELECT user_id, id, x.currency, CASE WHEN x.currency = 'CAD' THEN 1 ELSE rate END AS rate, strftime(CASE WHEN x.currency = 'CAD' THEN x.day ELSE fx.day END, '%Y-%m-%d') AS as_of, CAST(round(v * CASE WHEN x.currency = 'CAD' THEN 1 ELSE rate END, 2) AS {M}) AS in_base FROM x ASOF LEFT JOIN fx ON fx.currency = x.currency AND x.day >= fx.day""")
ORACLES["currencies_without_quotes"] = with_views(["t", "fx"], "SELECT DISTINCT c AS currency FROM (SELECT CASE id % 7 WHEN 5 THEN 'GBP' ELSE currency END AS c FROM t) WHERE c <> 'CAD' AND c NOT IN (SELECT currency FROM fx)")
_NAIVE_C = with_views(["tc", "rc"], "").rstrip().replace("tc AS (", "t AS (", 1).replace("rc AS (", "r AS (", 1) + ", " + NAIVE.replace("g <= 45", "g <= 100000 OR g IS NULL").replace("r.id AS document_id,", "r.id AS document_id, r.vendor,", 1)
ORACLES["candidate_counts_by_customer"] = _NAIVE_C + f""" SELECT r.user_id, r.id AS document_id, count(cand.transaction_id) FILTER (cand.match_reason IS NOT NULL) AS n, CAST(0 AS BIGINT) AS n_printed FROM r LEFT JOIN cand ON cand.user_id = r.user_id AND cand.document_id = r.id
 WHERE r.currency_source <> 'assumed' AND r.currency IS NOT NULL AND EXISTS (SELECT 1 FROM t WHERE t.user_id = r.user_id AND t.status = 'UNMATCHED' AND t.transaction_type = 'DEBIT') GROUP BY ALL
 UNION ALL SELECT user_id, id, 0, 0 FROM r WHERE r.currency_source <> 'assumed' AND r.currency IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = r.user_id AND t.status = 'UNMATCHED' AND t.transaction_type = 'DEBIT')"""
ORACLES["unambiguous_by_customer"] = _NAIVE_C + """,
 lone AS (SELECT user_id, document_id FROM cand WHERE match_reason IS NOT NULL GROUP BY ALL HAVING count(*) = 1)
 SELECT cand.user_id, transaction_id, cand.document_id FROM cand JOIN lone ON lone.user_id = cand.user_id AND lone.document_id = cand.document_id
 WHERE match_reason IS NOT NULL AND c = currency AND abs(a - d) <= 0.02 AND gap <= 3 AND len(list_filter(regexp_extract_all(lower(vendor), '[a-z]{3,}'), lambda w : contains(lower(description), w))) > 0"""
# each match has one row, so what its actions do can be written as cases: a rejected one can't be reassigned or removed
_FATE = """, k AS (SELECT user_id, transaction_id, match_id AS id, document_id, status, status = 'USER_REJECTED' AS gone, match_id % 3 = 0 AND status <> 'USER_REJECTED' AS moved, match_id % 5 = 0 AS asked, match_id % 7 = 0 AS replaced, match_id % 11 = 0 AS proven FROM ev WHERE seq = 0),
 z AS (SELECT *, asked AND NOT gone AND NOT moved AS removed, replaced AND moved AS dropped FROM k),
 o AS (SELECT user_id, transaction_id, id AS match_id, document_id, CASE WHEN moved OR removed THEN 'USER_REJECTED' ELSE status END AS status, CASE WHEN moved THEN 'reassigned' WHEN removed THEN 'remove_proof' END AS user_action, 'ONE_TO_ONE' AS match_type, CAST(CASE WHEN moved THEN 1 WHEN removed THEN 2 ELSE 0 END AS BIGINT) AS seq FROM z
  UNION ALL SELECT user_id, transaction_id, id + 10000000, document_id + 4, CASE WHEN dropped THEN 'USER_REJECTED' ELSE 'USER_APPROVED' END, CASE WHEN dropped THEN 'superseded' ELSE 'manual_match' END, 'ONE_TO_ONE', CASE WHEN dropped THEN 4 ELSE 1 END FROM z WHERE moved
  UNION ALL SELECT user_id, transaction_id, id + 20000000, document_id + 8, 'USER_APPROVED', 'add_proof', 'MANY_TO_ONE', 5 FROM z WHERE proven)"""
ORACLES["review_actions_folded"] = with_views(["ev"], _FATE + " SELECT * FROM o")
ORACLES["review_audit"] = with_views(["ev"], _FATE + """ SELECT ev.user_id, ev.transaction_id, ev.seq, action, match_id, CASE WHEN seq = 1 THEN CASE WHEN gone THEN 'refused: already gone' ELSE 'applied' END WHEN seq = 2 THEN CASE WHEN removed THEN 'applied' ELSE 'refused: already gone' END
 WHEN seq = 4 THEN CASE WHEN moved THEN 'applied' ELSE 'refused: unknown match' END ELSE 'applied' END AS outcome, CASE WHEN seq = 1 AND moved THEN z.status WHEN seq = 2 AND removed THEN z.status WHEN seq = 4 AND moved THEN 'USER_APPROVED' END AS old_value FROM ev JOIN z ON z.user_id = ev.user_id AND z.transaction_id = ev.transaction_id WHERE seq > 0""")
ORACLES["review_resync"] = with_views("trl", "").rstrip() + ", " + with_views(["ev"], _FATE).removeprefix("WITH ") + f""",
 et AS (SELECT user_id, transaction_id AS id, bool_or(status IN {PROOF}) AS a, bool_or(status = 'PENDING_REVIEW') AS p FROM o GROUP BY ALL HAVING bool_or(user_action IS NOT NULL)), ed AS (SELECT user_id, document_id AS id, bool_or(status IN {PROOF}) AS a, bool_or(status = 'PENDING_REVIEW') AS p FROM o GROUP BY ALL HAVING bool_or(user_action IS NOT NULL)),
 ln AS (SELECT user_id, source_transaction_id AS id FROM l WHERE status <> 'USER_REJECTED' UNION SELECT user_id, target_transaction_id FROM l WHERE status <> 'USER_REJECTED'),
 st AS (SELECT t.user_id, 'transaction' AS side, t.id, t.status, CASE WHEN t.status = 'IGNORED' AND ln.id IS NOT NULL THEN 'LINKED' WHEN t.status IN ('IGNORED', 'EXCLUDED', 'PENDING_REVIEW') THEN t.status WHEN a THEN 'MATCHED' WHEN p THEN t.status WHEN ln.id IS NOT NULL THEN 'LINKED' ELSE 'UNMATCHED' END AS derived
  FROM t JOIN et ON et.user_id = t.user_id AND et.id = t.id LEFT JOIN ln ON ln.user_id = t.user_id AND ln.id = t.id),
 sd AS (SELECT r.user_id, 'receipt' AS side, r.id, r.status, CASE WHEN a THEN 'MATCHED' WHEN p THEN r.status WHEN r.status = 'MATCHED' THEN 'EXTRACTED' ELSE r.status END AS derived FROM r JOIN ed ON ed.user_id = r.user_id AND ed.id = r.id)
 SELECT * FROM st WHERE status <> derived UNION ALL SELECT * FROM sd WHERE status <> derived"""
_RELEASE = lambda name, since: f"""{name} AS (SELECT naics, band, cohort, bucket, avg(p) AS pct, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS median, quantile_cont(p, 0.75) AS q3, count(*) AS businesses FROM
  (SELECT c_mktsegment AS naics, CASE WHEN c_acctbal < 5000 THEN '30K-5M' ELSE '5M-20M' END AS band, concat('n', c_nationkey) AS cohort, bucket, CAST(amount AS DOUBLE) / CAST(revenue AS DOUBLE) AS p
   FROM (SELECT user_id, coalesce(category, 'other') AS bucket, sum({ABS}) AS amount FROM tc WHERE date_posted >= '{since}' AND transaction_type = 'DEBIT' GROUP BY ALL) s JOIN (SELECT user_id, sum({ABS}) AS revenue FROM tc WHERE date_posted >= '{since}' AND transaction_type = 'CREDIT' GROUP BY ALL) v ON v.user_id = s.user_id JOIN customer ON c_custkey = s.user_id) x GROUP BY ALL)"""  # noqa: E731
_TWO = with_views(["tc"], "").rstrip() + ",\n " + _RELEASE("nw", "1998-01-01") + ",\n " + _RELEASE("od", "1995-01-01")
_BAD = "(SELECT naics, band, cohort, bucket, 'share' AS error FROM nw WHERE NOT pct BETWEEN 0 AND 8 UNION ALL SELECT naics, band, cohort, bucket, 'order' FROM nw WHERE q1 > q3 OR NOT median BETWEEN q1 AND q3)"
ORACLES["cube_line_errors"] = f"{_TWO} SELECT * FROM {_BAD}"
_CMP = """cm AS (SELECT coalesce(a.naics, b.naics) AS naics, coalesce(a.band, b.band) AS band, coalesce(a.cohort, b.cohort) AS cohort, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' ELSE 'kept' END AS change, coalesce(a.n, 0) AS n_new, coalesce(b.n, 0) AS n_old
 FROM (SELECT naics, band, cohort, count(*) AS n FROM nw GROUP BY ALL) a FULL JOIN (SELECT naics, band, cohort, count(*) AS n FROM od GROUP BY ALL) b ON b.naics = a.naics AND b.band = a.band AND b.cohort = a.cohort)"""
ORACLES["cube_compared"] = f"{_TWO}, {_CMP} SELECT * FROM cm"
ORACLES["cube_verdict"] = f"""{_TWO}, {_CMP}, e AS (SELECT 1 FROM {_BAD} UNION ALL SELECT 1 FROM (SELECT sum(CASE WHEN pct BETWEEN 0 AND 8 THEN pct ELSE 0 END) AS f, 1 - sum(pct) AS m FROM nw GROUP BY naics, band, cohort) WHERE f > 20 UNION ALL SELECT 1 FROM (SELECT 1 - sum(pct) AS m FROM nw GROUP BY naics, band, cohort) WHERE NOT m BETWEEN -15 AND 1.5),
 s AS (SELECT count(*) FILTER (change <> 'removed') AS n_new, count(*) FILTER (change <> 'added') AS n_old, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed FROM cm)
 SELECT *, (SELECT count(*) FROM e) AS n_errors, array_to_string(list_filter([CASE WHEN n_new = 0 THEN 'empty' END, CASE WHEN n_new < 0.95 * n_old THEN 'regressed' END, CASE WHEN (SELECT count(*) FROM e) > 0 THEN 'errors' END], lambda x: x IS NOT NULL), ',') AS refused_for FROM s"""

_PCT = lambda c: f"CASE WHEN TRY_CAST(replace({c}, '%', '') AS DOUBLE) < 9999 THEN TRY_CAST(replace({c}, '%', '') AS DOUBLE) / 100 END"
ORACLES["benchmark_file_lines"] = with_views(["bf"], f"""SELECT file, row, a0 AS naics, a2 AS province, 'rent' AS bucket, {_PCT("a3")} AS pct, nullif(trim(a4), '') AS quality, {_PCT("a5")} AS q1, {_PCT("a6")} AS q2, {_PCT("a7")} AS q3, {_PCT("a8")} AS q4 FROM bf
 UNION ALL SELECT file, row, a0, a2, 'net_profit_margin', {_PCT("a10")}, nullif(trim(a4), ''), {", ".join(f"CASE WHEN file = 'f0' THEN {_PCT(c)} END" for c in ("a5", "a6", "a7", "a8"))} FROM bf""")

# receipts of twenty-five years later, compared by their best date
_DATED = """r0 AS (SELECT *, CAST(CAST(document_date AS DATE) + INTERVAL 300 MONTH AS DATE) AS d0, id % 10 AS k FROM r1),
 r2 AS (SELECT *, CASE k WHEN 1 THEN d0 + 9 WHEN 2 THEN d0 + 12 WHEN 4 THEN d0 + 20 ELSE d0 END AS own, CASE WHEN k = 3 AND year(d0 + to_months(CAST(id % 4 AS INT))) BETWEEN 2020 AND 2030 THEN make_date(year(d0 + to_months(CAST(id % 4 AS INT))), month(d0 + to_months(CAST(id % 4 AS INT))), 15) END AS hint FROM r0),
 r AS (SELECT * REPLACE (strftime(CASE WHEN (year(hint) - year(own)) * 12 + month(hint) - month(own) BETWEEN 1 AND 2 THEN hint ELSE coalesce(own, hint) END, '%Y-%m-%d') AS document_date) FROM r2)"""
ORACLES["best_dates"] = with_views("r", "").rstrip().replace("r AS (", "r1 AS (", 1) + f", {_DATED} SELECT user_id, id, document_date AS best FROM r"
ORACLES["receipt_candidates_by_best_date"] = with_views("tr", "").rstrip().replace("t AS (", "t1 AS (", 1).replace("r AS (", "r1 AS (", 1) + f""", {_DATED},
 t AS (SELECT * REPLACE (strftime(CAST(CAST(date_posted AS DATE) + INTERVAL 300 MONTH AS DATE), '%Y-%m-%d') AS date_posted) FROM t1), {NAIVE} SELECT user_id, transaction_id, document_id, match_reason, gap FROM cand WHERE match_reason IS NOT NULL"""

# Scores of pairs with likeness of texts: longest common subsequences are computed row by row for the few distinct texts.
_ANY = lambda c, ps: "regexp_matches(coalesce(" + c + ", ''), '(?i)" + "|".join(f"(?:{p})".replace("'", "''") for p in ps) + "')"
_KEY = lambda c: f"""CASE {" ".join(f"WHEN {_ANY(f'trim({c})', [p])} THEN '{k}'" for p, k in X.PROCESSOR_ACTIONS)} {" ".join(f"WHEN {_ANY(_HEAD.replace('description', c), [p])} THEN '{k}'" for p, k in X.VENDOR_ALIASES)} ELSE array_to_string(list_filter(string_split(regexp_replace({_HEAD.replace("description", c)}, '[^a-z0-9]+', '_', 'g'), '_'), lambda x: x <> '')[1:2], '_') END"""
_WORDS = lambda c, known: f"list_filter(regexp_extract_all({c}, '[A-Za-z]{{3,}}'), lambda x: lower(x) NOT IN ({q(sorted(known))}))"
_LOW = lambda xs: f"list_distinct(list_transform({xs}, lambda x: lower(x)))"
_LONG = lambda xs: f"list_filter({xs}, lambda x: length(x) >= 4)"
_BOTH = " OR ".join(f"({_ANY('label', [p])} AND {_ANY('v', [p])})" for p, _ in X.VENDOR_ALIASES)
SCORED = f"""{NAIVE.replace("r.id AS document_id,", "r.id AS document_id, r.vendor, r.original_filename,", 1)},
 tx AS MATERIALIZED (SELECT DISTINCT description AS d, vendor AS v, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(original_filename), '[a-z]{{3,}}'))), ' ') AS f FROM cand WHERE match_reason IS NOT NULL),
 wd AS (SELECT *, {_WORDS("d", X.BANK_NOISE + X.PAYMENT_RAILS)} AS raw, {_LOW(_WORDS("v", X.BANK_NOISE))} AS sold, {_LOW(_WORDS("f", X.BANK_NOISE))} AS fw FROM tx),
 st AS (SELECT *, {_LOW("raw")} AS printed, list_distinct(list_concat(sold, fw)) AS receipt, array_to_string(raw[1:3], ' ') AS label, CASE WHEN len(sold) > 0 THEN array_to_string(list_sort(sold), ' ') ELSE v END AS name FROM wd),
 jd AS MATERIALIZED (SELECT *, CASE WHEN len(printed) = 0 OR len(receipt) = 0 OR list_has_any(printed, receipt) OR EXISTS (SELECT 1 FROM (SELECT unnest({_LONG("printed")}) AS p) a, (SELECT unnest({_LONG("receipt")}) AS o) b WHERE contains(p, o) OR contains(o, p))
   OR ({_KEY("label")} = {_KEY("v")} AND {_KEY("label")} <> '') OR {_BOTH} OR {_ANY("d", X.INTERMEDIARIES)} THEN false WHEN {_ANY("label", [p for p, _ in X.VENDOR_ALIASES])} THEN true END AS said,
  len(list_filter(regexp_extract_all(lower(v), '[a-z]{{3,}}'), lambda w: contains(lower(d), w))) > 0 AS word, {_ANY("d", X.INTERMEDIARIES)} AS rail, CAST(list_sum(list_transform(string_split(lower(v), ''), lambda c: ascii(c))) AS BIGINT) % 100 AS code FROM st),
 un AS (SELECT d, v, f, unnest({_LONG("printed")}) AS w, receipt, name FROM jd WHERE said IS NULL),
 us AS (SELECT d, v, f, w, name, CASE WHEN length(w) <= length(name) THEN w ELSE name END AS a, CASE WHEN length(w) <= length(name) THEN name ELSE w END AS b FROM un),
 ui AS (SELECT *, unnest(range(1 - length(a), length(b))) AS i FROM us),
 uw AS (SELECT d, v, f, w, w AS a, unnest(receipt) AS b FROM un UNION ALL SELECT d, v, f, w, a, substr(b, CAST(greatest(i, 0) + 1 AS BIGINT), CAST(i + length(a) - greatest(i, 0) AS BIGINT)) FROM ui),
 ab AS MATERIALIZED (SELECT lower(d) AS a, lower(v) AS b FROM jd WHERE NOT word AND NOT rail UNION SELECT a, b FROM uw WHERE b <> ''),
 rc AS (SELECT a, b, CAST(0 AS BIGINT) AS i, list_transform(range(length(a)), lambda j: CAST(0 AS BIGINT)) AS row FROM ab
  UNION ALL SELECT a, b, i + 1, list_transform(range(1, length(a) + 1), lambda j: list_max(c[1:j])) FROM (SELECT a, b, i, list_transform(range(1, length(a) + 1), lambda j: CASE WHEN a[j] = b[i + 1] THEN CASE WHEN j = 1 THEN 0 ELSE row[j - 1] END + 1 ELSE row[j] END) AS c FROM rc WHERE i < length(b))),
 lk AS MATERIALIZED (SELECT a, b, 200.0::DOUBLE * row[length(a)] / (length(a) + length(b)) AS r FROM rc WHERE i = length(b)),
 fz AS (SELECT d, v, f, bool_or(best < 50) AS other FROM (SELECT d, v, f, w, max(coalesce(r, 0)) AS best FROM uw LEFT JOIN lk ON lk.a = uw.a AND lk.b = uw.b GROUP BY ALL) GROUP BY ALL),
 vs AS MATERIALIZED (SELECT jd.d, jd.v, jd.f, CASE WHEN d = '' OR v = '' THEN 0.0 WHEN word THEN 0.8 WHEN rail THEN 0.45::DOUBLE + code / 500.0::DOUBLE ELSE (SELECT r FROM lk WHERE lk.a = lower(jd.d) AND lk.b = lower(jd.v)) / 100.0::DOUBLE END AS vendor_score, coalesce(said, (SELECT other FROM fz WHERE fz.d = jd.d AND fz.v = jd.v AND fz.f = jd.f), false) AS con FROM jd),
 sc AS (SELECT *, CAST({_AMOUNT} AS DOUBLE) AS am, CAST({_DATE} AS DOUBLE) AS da, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(original_filename), '[a-z]{{3,}}'))), ' ') AS f FROM cand WHERE match_reason IS NOT NULL),
 z AS MATERIALIZED (SELECT sc.*, CAST(vs.vendor_score AS DOUBLE) AS vendor_score, con, 0.5::DOUBLE * am + 0.3::DOUBLE * da + 0.2::DOUBLE * CAST(vs.vendor_score AS DOUBLE) AS conf FROM sc JOIN vs ON vs.d = sc.description AND vs.v = sc.vendor AND vs.f = sc.f)"""
ORACLES["pair_scores"] = with_views("tr", f", {SCORED} SELECT user_id, transaction_id, document_id, am AS amount_score, da AS date_score, round(vendor_score, 9) AS vendor_score, round(conf, 9) AS confidence FROM z", recursive=True)
_FLAG = "(conf < 0.60 OR am <= 0.05 OR con)"


def _auction(rounds: int = 3) -> str:
    """The rounds of the auction, one after another: what is taken in one isn't offered in the next."""
    out, free = "", "z"
    for k in range(1, rounds + 1):
        out += f""",
 o{k} AS MATERIALIZED (SELECT * FROM {free} QUALIFY row_number() OVER (PARTITION BY user_id, document_id ORDER BY conf DESC, gap, transaction_id) = 1),
 w{k} AS MATERIALIZED (SELECT *, {k} AS round FROM o{k} QUALIFY row_number() OVER (PARTITION BY user_id, transaction_id ORDER BY {_FLAG}, conf DESC, am DESC, gap, document_id) = 1),
 z{k} AS MATERIALIZED (SELECT * FROM {free} x WHERE NOT EXISTS (SELECT 1 FROM w{k} w WHERE w.user_id = x.user_id AND w.transaction_id = x.transaction_id) AND NOT EXISTS (SELECT 1 FROM w{k} w WHERE w.user_id = x.user_id AND w.document_id = x.document_id))"""
        free = f"z{k}"
    return out + ",\n won AS (" + " UNION ALL ".join(f"SELECT * FROM w{k}" for k in range(1, rounds + 1)) + ")"


ORACLES["receipt_assignment"] = with_views("tr", f""", {SCORED}{_auction()}
 SELECT user_id, transaction_id, document_id, CAST(round AS INT) AS round, CASE WHEN {_FLAG} THEN 'FLAGGED' WHEN conf >= 0.90 THEN 'AUTO_APPROVED' ELSE 'PENDING_REVIEW' END AS decision, CASE WHEN {_FLAG} OR conf <= 0.90 THEN 'PENDING_REVIEW' ELSE 'AUTO_APPROVED' END AS stored_status,
 CASE WHEN conf >= 0.75 THEN 'high' WHEN conf >= 0.50 THEN 'medium' ELSE 'low' END AS label, array_to_string(list_filter([CASE WHEN conf < 0.60 THEN 'low_confidence' END, CASE WHEN am <= 0.05 THEN 'amount' END, CASE WHEN con THEN 'merchant' END], lambda x: x IS NOT NULL), ',') AS reasons FROM won""", recursive=True)
ORACLES["match_explanations"] = with_views("tr", f""", {SCORED} SELECT user_id, transaction_id, document_id, CASE WHEN conf >= 0.85 THEN 'HIGH' WHEN conf >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END AS label,
 array_to_string(list_filter([CASE WHEN da < 0.5 THEN 'date' END, CASE WHEN vendor_score < 0.35 THEN 'vendor' END, CASE WHEN con THEN 'merchant' END, CASE WHEN c IS NULL THEN 'assumed_currency' END, CASE WHEN c <> currency THEN 'fx' END], lambda x: x IS NOT NULL), ',') AS flags,
 printf('%s and %s differ by %.2f; %d days apart', description, vendor, CAST(abs(a - d) AS DOUBLE), gap) AS summary FROM z""", recursive=True)
ORACLES["unmatched_diagnosis"] = with_views("tr", f""", {SCORED}{_auction()}, best AS (SELECT user_id, transaction_id, arg_max(document_id, (conf, -document_id)) AS best_document, max(conf) AS best_confidence FROM z GROUP BY ALL)
 SELECT t.user_id, t.id AS transaction_id, best_document, best_confidence, CASE WHEN best_confidence IS NULL THEN 'no_candidate' WHEN best_confidence < 0.60 THEN 'weak_candidate' ELSE 'taken_by_another' END AS reason
 FROM t LEFT JOIN best ON best.user_id = t.user_id AND best.transaction_id = t.id WHERE t.status = 'UNMATCHED' AND t.transaction_type = 'DEBIT' AND NOT EXISTS (SELECT 1 FROM won WHERE won.user_id = t.user_id AND won.transaction_id = t.id)""", recursive=True)

# statement files, order exports and payloads
_O = "o_orderkey AS id, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) AS amt, strftime(o_orderdate, '%Y-%m-%d') AS day"
ORACLES["statement_csv_rows"] = with_views(["cs"], f""", x AS (SELECT cs.file AS source_file, cs.row AS source_row, kind, {_O} FROM cs JOIN orders ON o_orderkey = cs.id WHERE kind >= 0),
 y AS (SELECT *, CASE WHEN kind < 2 THEN CASE WHEN id % 2 = 0 THEN amt ELSE '-' || amt END WHEN kind = 2 THEN CASE WHEN id % 3 = 0 THEN '-' ELSE '' END || amt ELSE CASE WHEN id % 3 = 0 THEN '' ELSE '-' END || amt END AS amount FROM x)
 SELECT CASE kind WHEN 0 THEN 'CAD' WHEN 1 THEN 'USD' WHEN 2 THEN 'CreditCard' WHEN 3 THEN 'Wise' ELSE 'PayPal' END AS account, CASE WHEN id % 3 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type, day AS date_posted, amount, CASE kind WHEN 1 THEN 'USD' WHEN 3 THEN 'USD' WHEN 4 THEN 'EUR' ELSE 'CAD' END AS currency,
 CASE kind WHEN 2 THEN 'Card shop' WHEN 3 THEN CASE WHEN id % 2 = 0 THEN 'Invoice ' ELSE '' END || '(USD -> ' || amt || ' EUR @ 1.5)' WHEN 4 THEN 'Ann — Express Checkout Payment' || CASE WHEN id % 7 = 0 THEN ' — fee -0.50' ELSE '' END ELSE 'Shop, no. ' || id END AS description, source_file, source_row
 FROM y WHERE NOT (kind = 3 AND id % 4 = 0) AND NOT (kind = 4 AND (id % 8 = 1 OR id % 9 = 0 OR id % 6 = 0))""")
_EXPORT = f"""x AS (SELECT file, row, CAST(id AS VARCHAR) AS order_id, CAST(day AS DATE) AS ship_date, CASE WHEN id % 2 = 0 THEN 'Thing ' ELSE 'Title, ' END || n AS name, CASE WHEN id % 2 = 0 THEN 'USD' ELSE 'CAD' END AS currency, n,
  CASE WHEN id % 2 = 0 THEN CAST(tax AS {M}) ELSE CAST(tax AS {M}) + 1 + CASE WHEN n % 2 = 0 THEN 0.10 ELSE 0 END END AS tax, CAST(price AS {M}) AS price, CAST(qty AS INT) AS qty, CASE WHEN id % 2 = 0 THEN 'closed' ELSE '' END AS status FROM oe WHERE k = 1 AND n % 5 <> 0),
 e AS (SELECT file, row, order_id, ship_date, name, currency, CAST(CASE WHEN n % 3 = 0 THEN price * qty + tax ELSE price END AS {M}) AS total, CAST(tax AS {M}) AS tax, status FROM x)"""
ORACLES["order_export_lines"] = with_views(["oe"], f", {_EXPORT} SELECT * FROM e")
ORACLES["order_export_shipments"] = with_views(["oe"], f""", {_EXPORT} SELECT strftime(ship_date, '%Y-%m-%d') AS date_posted, CAST(CAST(sum(total) AS {M}) AS VARCHAR) AS amount, arg_min(currency, row) AS currency, substr(string_agg(name, '; ' ORDER BY row, name), 1, 500) AS description, CAST(sum(tax) AS {M}) AS tax, order_id, min(row) AS source_row FROM e GROUP BY order_id, ship_date""")
ORACLES["model_payload_rows"] = with_views("t", f""", x AS (SELECT 'm' || user_id || '-' || substr(date_posted, 1, 7) AS file, *, {ABS} AS a FROM t)
 SELECT file, row_number() OVER (PARTITION BY file ORDER BY id) - 1 AS row, date_posted AS date, CAST(a AS VARCHAR) AS amount, CASE WHEN id % 5 = 0 THEN 'CREDIT' WHEN id % 2 = 1 THEN 'DEBIT' WHEN id % 3 = 0 AND CAST(amount AS {M}) >= 0 THEN 'CREDIT' ELSE 'DEBIT' END AS type, description FROM x""")
ORACLES["wallet_api_rows"] = with_views("t", f"""SELECT CASE WHEN CAST(amount AS {M}) < 0 THEN 'DEBIT' ELSE 'CREDIT' END AS transaction_type, date_posted, amount, currency, CASE id % 4 WHEN 0 THEN 'Ann' WHEN 1 THEN 'Subject' WHEN 2 THEN 'Harbour' ELSE 'PayPal' END AS description FROM t WHERE id % 10 <> 7 AND id % 6 NOT IN (1, 4) AND CAST(amount AS {M}) <> 0""")
_FEE = [p for name, _, ps in X.CATEGORY_RULES if name == "Interest and bank charges" for p in ps]
_PLAIN = [p.replace("(?!Fee)", "") for p in _FEE]
ORACLES["transfer_service_rows"] = with_views("t", f""", x AS (SELECT *, CASE WHEN id % 2 = 0 THEN description WHEN id % 3 > 0 THEN 'REF-' || id ELSE 'Wise transaction ' || CASE WHEN id % 6 = 0 THEN 'DEPOSIT' ELSE 'CARD' END END AS said FROM t)
 SELECT CASE WHEN CAST(amount AS {M}) >= 0 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type, date_posted, amount, CASE WHEN id % 5 > 0 THEN currency ELSE 'USD' END AS currency, CASE WHEN id % 7 = 0 AND NOT {_ANY("said", _PLAIN)} THEN '{X.FEE_PREFIX}' || said ELSE said END AS description FROM x""")

# patterns across buckets, cached decisions, judged links
_TAX = ", ".join("({}, {}, {}, {}, {}, {})".format(*(("NULL" if x is None else str(x).lower() if isinstance(x, bool) else repr(x) if isinstance(x, float) else "'" + str(x).replace("'", "''") + "'") for x in (c, k, b, o, g, w))) for c, k, _, b, _, _, o, w, g in X.TAXONOMY)
_FACTS = f"""tx AS (SELECT * FROM (VALUES {_TAX}) x(category, kind, bucket, operating, generic, scrutiny)), ra AS (SELECT * FROM (VALUES ('CAD', 1.000000), ('USD', 1.370000)) x(currency, rate)),
 ro AS (SELECT user_id, coalesce(tc.category, 'Uncategorized') AS category, currency, sum(CASE WHEN transaction_type = 'CREDIT' THEN {ABS} ELSE 0 END) AS income, sum(CASE WHEN transaction_type = 'DEBIT' THEN {ABS} ELSE 0 END) AS expenses FROM tc WHERE status <> 'EXCLUDED' GROUP BY ALL),
 rr AS (SELECT user_id, ro.category, coalesce(bucket, 'other_operating') AS bucket, coalesce(scrutiny, 1.0) AS scrutiny, coalesce(generic, false) AS generic, coalesce(operating, false) AS operating, CAST(income * rate AS DOUBLE) AS income, CAST(expenses * rate AS DOUBLE) AS spent FROM ro LEFT JOIN tx ON tx.category = ro.category JOIN ra ON ra.currency = ro.currency WHERE coalesce(bucket, '') NOT IN ('transfer', 'non_operating')),
 pc AS (SELECT user_id, bucket, category, sum(CASE WHEN NOT operating AND spent > 0 THEN spent ELSE 0 END) AS spent, sum(CASE WHEN operating THEN income ELSE 0 END) AS revenue, sum(CASE WHEN operating AND generic THEN income ELSE 0 END) AS generic, max(CASE WHEN NOT operating AND spent > 0 THEN scrutiny END) AS scrutiny, bool_or(CASE WHEN operating THEN income >= 500 ELSE spent > 0 AND spent >= 500 END) AS material FROM rr GROUP BY ALL),
 pb2 AS (SELECT user_id, bucket, sum(spent) AS spent, sum(revenue) AS revenue, sum(generic) AS generic, max(scrutiny) AS scrutiny, count(*) FILTER (material) AS sources FROM pc GROUP BY ALL),
 fa AS (SELECT user_id, sum(revenue) AS revenue, sum(generic) AS generic, sum(spent) AS spent, bool_or(sources >= 2) AS fragmented, CAST(count(*) FILTER (spent > 0) AS INT) AS n_buckets FROM pb2 GROUP BY ALL)"""
ORACLES["peer_facts"] = with_views(["tc"], f", {_FACTS} SELECT user_id, round(revenue, 4) AS revenue, round(generic, 4) AS generic, 0.0 AS drawn, round(spent, 4) AS spent, fragmented, n_buckets FROM fa")
_B = lambda b: f"coalesce((SELECT spent FROM pb2 WHERE pb2.user_id = fa.user_id AND bucket = '{b}'), 0)"
_W = lambda b, other: f"greatest(coalesce((SELECT scrutiny FROM pb2 WHERE pb2.user_id = fa.user_id AND bucket = '{b}' AND spent > 0), {other}), 1.0)"
_FLAGS = f"""{_FACTS}, fb AS (SELECT fa.*, {_B("subcontracts")} + {_B("professional_fees")} AS con, {_B("salaries_wages")} + {_B("employee_benefits")} AS lab FROM fa WHERE revenue > 0),
 fc AS (SELECT *, lab + con > 0 AND con > 0.6 * (lab + con) AND con / revenue > 0.25 AS skew FROM fb),
 ra0 AS (SELECT pb2.user_id, 'ratio_' || bucket || '_high' AS flag_key, 'A' AS layer, CASE WHEN pb2.spent / fc.revenue > 0.25 THEN 'stands_out' ELSE 'elevated' END AS severity, bucket, CAST(round(CAST(pb2.spent AS DECIMAL(24,6)), 2) AS DOUBLE) AS amount, pb2.spent / fc.revenue AS your_pct, pb2.spent / fc.revenue * 4 AS weight FROM pb2 JOIN fc ON fc.user_id = pb2.user_id
  WHERE bucket IN ('subcontracts', 'insurance', 'travel', 'professional_fees') AND pb2.spent / fc.revenue > 0.1 AND NOT (skew AND bucket IN ('subcontracts', 'professional_fees', 'salaries_wages'))),
 fl AS (SELECT * FROM ra0 UNION ALL SELECT user_id, 'pattern_contractor_heavy', 'B', 'elevated', 'subcontracts', CAST(round(CAST(con AS DECIMAL(24,6)), 2) AS DOUBLE), con / revenue, con / revenue * {_W("subcontracts", 1.5).replace("fa.", "fc.")} * 10 FROM fc WHERE skew
  UNION ALL SELECT user_id, 'pattern_generic_income_bucket', 'B', 'elevated', 'operating_revenue', CAST(round(CAST(generic AS DECIMAL(24,6)), 2) AS DOUBLE), generic / revenue, generic / revenue * 5 FROM fc WHERE generic / revenue > 0.5
  {" ".join(f"UNION ALL SELECT user_id, '{key}', 'B', 'elevated', '{b}', CAST(round(CAST({_B(b)} AS DECIMAL(24,6)), 2) AS DOUBLE), {_B(b)} / revenue, {_B(b)} / revenue * {_W(b, 2.0)} * 10 FROM fc WHERE {_B(b)} / revenue > 0.05 AND NOT EXISTS (SELECT 1 FROM ra0 WHERE ra0.user_id = fc.user_id AND ra0.bucket = '{b}')".replace("fa.", "fc.") for b, key in (("travel", "pattern_travel_over_threshold"), ("meals_entertainment", "pattern_meals_over_threshold"), ("motor_vehicle", "pattern_vehicle_over_threshold")))}
  UNION ALL SELECT user_id, 'pattern_expenses_exceed_revenue', 'B', 'stands_out', NULL, CAST(round(CAST(spent AS DECIMAL(24,6)), 2) AS DOUBLE), NULL, 12 FROM fc WHERE spent > revenue UNION ALL SELECT user_id, 'pattern_category_fragmentation', 'B', 'elevated', NULL, NULL, NULL, 3 FROM fc WHERE fragmented)"""
ORACLES["peer_flags"] = with_views(["tc"], f", {_FLAGS} SELECT user_id, flag_key, layer, severity, bucket, amount, round(your_pct, 9) AS your_pct, round(CAST(weight AS DOUBLE), 9) AS weight FROM fl")
ORACLES["peer_band"] = with_views(["tc"], f""", {_FLAGS}, g AS (SELECT *, user_id % 3 = 0 AND flag_key = 'pattern_travel_over_threshold' AS gone FROM fl), k AS (SELECT *, NOT gone AND row_number() OVER (PARTITION BY user_id, gone ORDER BY weight DESC, flag_key) <= 5 AS top FROM g),
 s AS (SELECT user_id, count(*) FILTER (NOT gone) AS n_flags, count(*) FILTER (gone) AS n_dismissed, count(*) FILTER (top) AS n, count(*) FILTER (top AND severity = 'stands_out') AS o, string_agg(flag_key, ',' ORDER BY weight DESC, flag_key) FILTER (top) AS shown FROM k GROUP BY user_id)
 SELECT fc.user_id, CASE WHEN o >= 2 OR n >= 4 THEN 'several' WHEN n > 0 THEN 'a_few' ELSE 'typical' END AS band, coalesce(shown, '') AS shown, coalesce(n_flags, 0) AS n_flags, coalesce(n_dismissed, 0) AS n_dismissed FROM fc LEFT JOIN s ON s.user_id = fc.user_id""")
ORACLES["vendor_cache_reuse"] = with_views("tm", f""", {VK}, pr AS (SELECT DISTINCT user_id, transaction_id AS id FROM m WHERE status IN {PROOF}),
 cl AS (SELECT vk.user_id, vendor_key, avg(CASE WHEN pr.id IS NULL THEN 0 ELSE 1 END) AS cover, max(category) AS cached FROM vk LEFT JOIN pr ON pr.user_id = vk.user_id AND pr.id = vk.id GROUP BY ALL
  UNION ALL SELECT user_id, vendor_key || '_only', 0, CASE WHEN user_id = 2 THEN 'No such category' ELSE max(category) END FROM vk WHERE id % 2 = 1 GROUP BY user_id, vendor_key)
 SELECT user_id, vendor_key, CASE WHEN cover <= 0 AND cached IN ({q(c for c, *_ in X.TAXONOMY)}) THEN cached END AS category, coalesce(cover <= 0 AND cached IN ({q(c for c, *_ in X.TAXONOMY)}), false) AS reused FROM cl""")
_BETTER = "(y.confidence_score > x.confidence_score OR (y.confidence_score = x.confidence_score AND y.u < x.u)) AND (y.u = x.v OR y.v = x.u)"
ORACLES["judged_links"] = with_views("c", f""", e AS (SELECT source_transaction_id AS u, target_transaction_id AS v, confidence_score FROM c WHERE confidence_score >= 0.55),
 a1 AS (SELECT * FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE {_BETTER})), e1 AS (SELECT * FROM e x WHERE NOT EXISTS (SELECT 1 FROM a1 y WHERE y.u IN (x.u, x.v) OR y.v IN (x.u, x.v))),
 a2 AS (SELECT * FROM e1 x WHERE NOT EXISTS (SELECT 1 FROM e1 y WHERE {_BETTER}))
 SELECT CAST(0 AS BIGINT) AS user_id, u AS source_id, v AS target_id, 'INTERNAL_TRANSFER' AS link_type, round(confidence_score * 0.95, 4) AS confidence, 0 AS chain_position FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2)""")

_CHAIN = ORACLES["transfer_pairs_scored"].split(" e AS (SELECT *, CASE WHEN y > 0", 1)[1].split(",\n m5 AS", 1)[0].replace(" FROM m1 WHERE am > 0", " FROM m1")
_KIND = "CASE WHEN same_account THEN CASE WHEN cx <> cy AND other_type THEN 'FX_CONVERSION' WHEN other_type THEN 'REFUND' ELSE 'OTHER' END WHEN cx <> cy AND rate IS NOT NULL THEN 'FX_CONVERSION' ELSE kw_type END"
_CHAIN = _CHAIN.replace("m3 AS (SELECT *,", "m30 AS (SELECT *,", 1).replace("AS link_type, CAST(CASE WHEN len(both_sides)", "AS kw_type, CAST(CASE WHEN len(both_sides)", 1).replace(" m4 AS (SELECT *,", f" m3 AS (SELECT *, {_KIND} AS link_type FROM m30),\n m4 AS (SELECT *,", 1)


def _picker(search: str | None, looked_at: int, shown: int) -> str:
    head = ORACLES["transfer_pairs_scored"].split(",\n s AS (SELECT * FROM w", 1)[0].replace("AS says FROM t)", "AS says, description FROM t WHERE user_id = 0)")
    fits = f"regexp_matches(b.description, '(?i){search}')" if search else "a.account <> b.account AND b.id <> a.id AND ln.id IS NULL"
    return f"""{head}, ln AS (SELECT DISTINCT CASE WHEN source_transaction_id = f.id THEN target_transaction_id ELSE source_transaction_id END AS id FROM l, (SELECT min(id) AS id FROM w) f WHERE user_id = 0 AND status <> 'USER_REJECTED' AND f.id IN (source_transaction_id, target_transaction_id)),
 p AS (SELECT b.id AS b_id, b.day AS b_day, b.id = a.id AS own, ln.id IS NOT NULL AS linked, a.account = b.account AS same_account, a.ty <> b.ty AS other_type, a.v AS x, b.v AS y, a.currency AS cx, b.currency AS cy, coalesce(a.rate, b.rate) AS rate, abs(date_diff('day', a.day, b.day)) AS gap, least(a.account, b.account) || '|' || greatest(a.account, b.account) AS accounts, a.ws AS aw, b.ws AS bw
  FROM w a JOIN w b ON a.id = (SELECT min(id) FROM w) LEFT JOIN ln ON ln.id = b.id WHERE {fits} ORDER BY b.day DESC, b.id LIMIT {looked_at}),
 e AS (SELECT *, CASE WHEN y > 0{_CHAIN}
 SELECT b_id AS id, strftime(b_day, '%Y-%m-%d') AS date_posted, link_type, am AS amount_score, da AS date_score, kw AS keyword_score, ac AS account_score, round(0.45::DOUBLE * am + 0.25::DOUBLE * da + 0.20::DOUBLE * kw + 0.10::DOUBLE * ac, 4) AS confidence, CASE WHEN own THEN 'self' WHEN linked THEN 'already_linked' END AS unavailable_reason
 FROM m4 ORDER BY unavailable_reason IS NOT NULL, confidence DESC, b_day DESC, b_id LIMIT {shown}"""


_WITH_LINKS = lambda sql: sql.replace("WITH ", with_views("l", "").rstrip() + ", ", 1)
ORACLES["link_picker_suggestions"] = _WITH_LINKS(_picker(None, 200, 100))
ORACLES["link_picker_search"] = _WITH_LINKS(_picker("wire|tfr|transfer|business", 1000, 500))

# uploads, orphaned statements, key precedence, run results and items with all their conditions
ORACLES["upload_outcomes"] = with_views("r", """, u AS (SELECT user_id, 'u' || id || ['.pdf', '.PNG', '.csv', '.docx'][id % 4 + 1] AS name, file_hash, CASE id % 4 WHEN 2 THEN 'csv' WHEN 3 THEN NULL ELSE 'receipt' END AS kind FROM r)
 SELECT user_id, name, file_hash, kind, CASE WHEN kind IS NULL THEN 'unsupported' WHEN kind = 'receipt' AND (EXISTS (SELECT 1 FROM r WHERE r.user_id = u.user_id AND r.file_hash = u.file_hash AND status = 'MATCHED' AND id % 3 = 0) OR EXISTS (SELECT 1 FROM u o WHERE o.user_id = u.user_id AND o.file_hash = u.file_hash AND o.kind = 'receipt' AND o.name < u.name)) THEN 'duplicate' ELSE 'new' END AS outcome FROM u""")
ORACLES["orphaned_statements"] = with_views("j", """ SELECT user_id, id FROM j s WHERE id < 1000 AND id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM j WHERE j.user_id = s.user_id AND j.kind = 'statement' AND j.status = 'pending' AND j.id % 7 <> 0 AND j.id % 1000 = s.id)""")
ORACLES["vendor_key_sources"] = with_views("tmr", f""", pv AS (SELECT m.user_id, transaction_id AS id, min(vendor) AS v FROM m JOIN r ON r.user_id = m.user_id AND r.id = m.document_id WHERE m.status IN {PROOF} AND transaction_id % 3 = 0 GROUP BY ALL),
 x AS (SELECT t.user_id, t.id, coalesce(pv.v, '') AS v, CASE WHEN t.id % 10 < 4 THEN '#' || t.id WHEN t.id % 10 = 4 THEN '' ELSE description END AS d FROM t LEFT JOIN pv ON pv.user_id = t.user_id AND pv.id = t.id),
 y AS (SELECT user_id, id, nullif({_KEY("v")}, '') AS kp, nullif({_KEY("d")}, '') AS kd, CASE WHEN id % 4 = 0 THEN 'kept' END AS ks, CASE WHEN id % 6 = 1 THEN 'told' END AS km, nullif(substr(split_part(trim(regexp_replace(lower(d), '[^a-z0-9]+', '_', 'g'), '_'), '_', 1), 1, 32), '') AS sl FROM x)
 SELECT user_id, id, coalesce(kp, kd, ks, km, sl, 'unknown') AS vendor_key, CASE WHEN kp IS NOT NULL THEN 'proof' WHEN kd IS NOT NULL THEN 'description' WHEN ks IS NOT NULL THEN 'stored' WHEN km IS NOT NULL THEN 'model' WHEN sl IS NOT NULL THEN 'slug' ELSE 'none' END AS key_source FROM y""")
_UNMATCHED = "(" + ORACLES["unmatched_docs_distinct"] + ")"
ORACLES["run_result_with_documents"] = f"""WITH a AS ({ORACLES["run_result"]}), b AS (SELECT user_id, count(*) AS n FROM {_UNMATCHED} GROUP BY user_id)
 SELECT a.* REPLACE (CASE WHEN run_status = 'nothing_to_reconcile' AND coalesce(n, 0) > 0 THEN 'no_matches' ELSE run_status END AS run_status), coalesce(n, 0) - matched AS remaining_documents FROM a LEFT JOIN b ON b.user_id = a.user_id"""
ORACLES["action_items_by_profile"] = with_views("tm", """, a AS (SELECT user_id, 'pending_reviews' AS item, count(*) AS n FROM m WHERE status = 'PENDING_REVIEW' GROUP BY ALL UNION ALL SELECT user_id, 'missing_receipts', count(*) FROM t WHERE status = 'UNMATCHED' GROUP BY ALL
 UNION ALL SELECT user_id, 'wise_detected', count(*) FROM t WHERE status = 'UNMATCHED' AND id % 9 = 8 AND user_id <> 2 GROUP BY ALL UNION ALL SELECT DISTINCT user_id, 'onboarding', 1 FROM t WHERE user_id <> 1) SELECT * FROM a WHERE n > 0""")
