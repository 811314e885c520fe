"""Ledger views derived from the driver's tables; each SELECT is valid in Spark SQL and in DuckDB."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SOURCES = ("orders", "events", "customer", "lineitem")

# name -> (source table, SELECT over it). `chain_links` gives chains of several edges, `matches` all four statuses.
VIEW_SQL = {
    "t": ("orders", """SELECT o_orderkey AS id, o_custkey % 4 AS user_id,
 CASE o_orderkey % 5 WHEN 0 THEN 'CAD' WHEN 1 THEN 'USD' WHEN 2 THEN 'CreditCard' WHEN 3 THEN 'Wise' ELSE 'PayPal' END AS account,
 CASE WHEN o_orderkey % 5 = 1 OR (o_orderkey % 5 = 3 AND o_orderkey % 2 = 1) THEN 'USD' ELSE 'CAD' END AS currency,
 CASE WHEN o_orderkey % 3 = 0 THEN 'CREDIT' ELSE 'DEBIT' END AS transaction_type,
 CAST(CAST(o_orderdate AS DATE) AS STRING) AS date_posted,
 CAST(CAST(o_totalprice AS DECIMAL(14,2)) * CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 5 = 2 THEN 1 ELSE -1 END AS STRING) AS amount,
 CASE o_orderkey % 9 WHEN 0 THEN 'MONTHLY FEE BUSINESS PLAN' WHEN 1 THEN 'USD TFR 000123456'
  WHEN 2 THEN 'Express Checkout Payment Orchid Telecom' WHEN 3 THEN 'AMZN Mktp CA*2K4' WHEN 4 THEN 'INCOMING WIRE HARBOURLINE'
  WHEN 5 THEN 'FUEL STATION 0042' WHEN 6 THEN 'BLUEPEAK SOFTWARE INC' WHEN 7 THEN 'OnlineTransfer,TF0000001234'
  ELSE 'WISE PAYMENTS 884120' END AS description,
 CASE WHEN o_orderkey % 17 = 0 THEN 'EXCLUDED' WHEN o_orderkey % 5 = 0 THEN 'IGNORED' WHEN o_orderkey % 2 = 0 THEN 'MATCHED' ELSE 'UNMATCHED' END AS status,
 CASE o_orderkey % 8 WHEN 0 THEN 'Travel' WHEN 1 THEN 'Software and IT' WHEN 2 THEN 'Internal transfer'
  WHEN 3 THEN 'Sales of goods and services' WHEN 4 THEN 'Rent' WHEN 5 THEN 'Insurance' WHEN 6 THEN 'Office supplies' ELSE NULL END AS category,
 CASE o_orderkey % 7 WHEN 0 THEN 'refund expected' WHEN 1 THEN 'not sure what this is' ELSE NULL END AS note,
 CASE o_orderkey % 3 WHEN 0 THEN 'stmt_a.csv' WHEN 1 THEN 'stmt_b.csv' ELSE 'paypal_c.csv' END AS source_file,
 o_orderkey % 50 AS source_row
FROM orders"""),
    "r": ("orders", """SELECT o_orderkey + 1000000 AS id, o_custkey % 4 AS user_id,
 CASE o_orderkey % 9 WHEN 2 THEN 'Orchid Telecom' WHEN 3 THEN 'Amazon.ca' WHEN 6 THEN 'Bluepeak Software Inc' ELSE 'Cedarview Supplies' END AS vendor,
 CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 - 5 AS INT) AS STRING) END AS document_date,
 CAST(CAST(o_totalprice AS DECIMAL(14,2)) + CASE o_orderkey % 7 WHEN 0 THEN CAST(0.03 AS DECIMAL(14,2)) WHEN 1 THEN CAST(1.50 AS DECIMAL(14,2)) ELSE CAST(0 AS DECIMAL(14,2)) END AS STRING) AS total,
 CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'USD' ELSE 'CAD' END AS currency,
 CASE WHEN o_orderkey % 13 = 0 THEN 'assumed' ELSE 'stated' END AS currency_source,
 CASE WHEN o_orderkey % 6 = 1 THEN CAST(CAST(o_totalprice * 0.05 AS DECIMAL(14,2)) AS STRING) WHEN o_orderkey % 31 = 0 THEN 'n/a' ELSE NULL END AS tax_gst,
 CASE WHEN o_orderkey % 12 = 5 THEN CAST(CAST(o_totalprice * 0.13 AS DECIMAL(14,2)) AS STRING) ELSE NULL END AS tax_hst,
 md5(CAST(o_orderkey - (CASE WHEN o_orderkey % 41 = 1 THEN 1 ELSE 0 END) AS STRING)) AS file_hash,
 CASE WHEN o_orderkey % 5 = 0 THEN 'MATCHED' ELSE 'EXTRACTED' END AS status,
 concat('receipt_', CAST(o_orderkey AS STRING), '.pdf') AS original_filename
FROM orders WHERE o_orderkey % 4 <> 3"""),
    "l": ("orders", """SELECT o_orderkey AS id, o_custkey % 4 AS user_id, o_orderkey AS source_transaction_id, o_orderkey + 1 AS target_transaction_id,
 CASE o_orderkey % 4 WHEN 0 THEN 'INTERNAL_TRANSFER' WHEN 2 THEN 'REFUND' ELSE 'CREDIT_CARD_PAYMENT' END AS link_type,
 CASE o_orderkey % 5 WHEN 0 THEN 'USER_REJECTED' WHEN 1 THEN 'PENDING_REVIEW' ELSE 'AUTO_APPROVED' END AS status,
 CAST((o_orderkey % 31 + 65) AS DOUBLE) / 100 AS confidence_score
FROM orders WHERE o_orderkey % 6 = 0"""),
    "c": ("orders", """SELECT o_orderkey AS id, CAST(0 AS BIGINT) AS user_id, o_orderkey AS source_transaction_id, o_orderkey + 1 AS target_transaction_id,
 CASE o_orderkey % 11 WHEN 5 THEN 'USER_REJECTED' ELSE 'AUTO_APPROVED' END AS status,
 CAST((o_orderkey % 31 + 65) AS DOUBLE) / 100 AS confidence_score
FROM orders WHERE o_orderkey % 7 IN (0, 1, 2)"""),
    "m": ("orders", """SELECT o_orderkey AS id, o_custkey % 4 AS user_id, o_orderkey AS transaction_id, o_orderkey + 1000000 AS document_id,
 CAST((o_orderkey % 41 + 60) AS DOUBLE) / 100 AS confidence_score,
 CASE o_orderkey % 10 WHEN 0 THEN 'USER_REJECTED' WHEN 2 THEN 'PENDING_REVIEW' WHEN 4 THEN 'USER_APPROVED' ELSE 'AUTO_APPROVED' END AS status,
 CASE WHEN o_orderkey % 14 = 0 THEN CAST(CAST(o_totalprice AS DECIMAL(14,2)) - 100 AS STRING) ELSE NULL END AS covered_amount
FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 2 = 0"""),
    "j": ("events", """SELECT event_id AS id, user_id % 4 AS user_id, CASE WHEN event_id % 5 = 0 THEN 'statement' ELSE 'receipt' END AS kind, ts AS created_at,
 CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'pending' ELSE 'done' END AS status, event_id AS position, value AS seconds
FROM events"""),
    # lines of bank statements over three months each: opening balance (not in all), lines with one, two or three amounts
    "sl": ("orders", """SELECT file, row, line FROM (
 SELECT file, row, CASE WHEN row = 0 THEN concat('Business Banking statement for the period ending ', substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * (last_month % 12) + 1, 3), ' 28, ', CAST(CAST(floor(last_month / 12) AS INT) AS STRING))
  WHEN row = 1 THEN CASE WHEN last_month % 4 = 0 THEN 'Summary' ELSE concat(mmdd, ' Opening balance 50000.00') END
  WHEN id % 37 = 6 THEN concat(mmdd, ' Closing totals ', amt, ' ', bal)
  WHEN id % 11 = 5 THEN concat(mmdd, ' ', said, ' ', amt)
  WHEN id % 13 = 4 THEN concat(mmdd, ' ', said, ' ', amt, ' 1.00 ', bal)
  ELSE concat(mmdd, ' ', said, ' ', amt, ' ', bal) END AS line
 FROM (SELECT file, id, last_month, CAST(row_number() OVER (PARTITION BY file ORDER BY d, id) + 1 AS BIGINT) AS row, said, concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * month(d) - 2, 3), lpad(CAST(day(d) AS STRING), 2, '0')) AS mmdd,
   CAST(amount AS STRING) AS amt, CAST(CAST(50000 + sum(CASE WHEN id % 3 = 0 THEN amount ELSE -amount END) OVER (PARTITION BY file ORDER BY d, id) AS DECIMAL(18,2)) AS STRING) AS bal
  FROM (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(14,2)) AS amount, CAST(3 * floor((12 * year(o_orderdate) + month(o_orderdate) + 1) / 3) AS INT) AS last_month,
    concat('s', CAST(o_custkey % 4 AS STRING), '-', CAST(CAST(floor((12 * year(o_orderdate) + month(o_orderdate) + 1) / 3) AS INT) AS STRING)) AS file,
    CASE o_orderkey % 4 WHEN 0 THEN 'IncomingWirePayment' WHEN 1 THEN 'OnlineTransfer,' WHEN 2 THEN 'InterestEarned' ELSE 'Harbour Cafe' END AS said FROM orders) x
  UNION ALL SELECT DISTINCT concat('s', CAST(o_custkey % 4 AS STRING), '-', CAST(CAST(floor((12 * year(o_orderdate) + month(o_orderdate) + 1) / 3) AS INT) AS STRING)) AS file, 0 AS id, CAST(3 * floor((12 * year(o_orderdate) + month(o_orderdate) + 1) / 3) AS INT) AS last_month, CAST(head AS BIGINT) AS row, '' AS said, 'Nov01' AS mmdd, '' AS amt, '' AS bal
  FROM orders, (SELECT 0 AS head UNION ALL SELECT 1 AS head) h) y) z"""),
    # rows of a wallet's tables: pages are months, dates of even tenants are day first, pages have no, one or two sections
    "wp": ("orders", """SELECT concat('w', CAST(o_custkey % 4 AS STRING), '-', CAST(year(o_orderdate) AS STRING)) AS file, month(o_orderdate) AS page, CAST(o_orderkey % 2 AS INT) AS n, o_orderkey AS id,
 CASE month(o_orderdate) % 4 WHEN 0 THEN '' WHEN 1 THEN 'USD' WHEN 2 THEN 'CAD,USD' ELSE 'CAD' END AS heads,
 CASE WHEN o_custkey % 2 = 0 THEN concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0')) ELSE concat(lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(day(o_orderdate) AS STRING), 2, '0')) END AS dd,
 CAST(year(o_orderdate) AS STRING) AS yyyy, CAST(CAST(o_totalprice AS DECIMAL(14,2)) * CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE -1 END AS STRING) AS gross,
 CASE o_orderkey % 12 WHEN 9 THEN 'General Currency Conversion' ELSE 'Express Checkout Payment' END AS said
FROM orders WHERE o_orderkey % 5 = 4"""),
    # answers of page batches: an order is a document, its lines are batches
    "pb": ("lineitem", """SELECT l_orderkey % 4 AS user_id, l_orderkey AS document_id, batch, CAST(2 * batch AS INT) AS last_page, CASE l_partkey % 3 WHEN 0 THEN 'true' WHEN 1 THEN 'no' ELSE NULL END AS continuation,
 CASE l_suppkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN 'NOT_A_FINANCIAL_DOCUMENT' WHEN 2 THEN '' ELSE concat('Vendor ', CAST(l_suppkey % 7 AS STRING)) END AS vendor, CASE l_partkey % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'CAD' WHEN 2 THEN 'USD' ELSE NULL END AS currency,
 CASE WHEN l_partkey % 5 = 0 THEN concat('I', CAST(l_partkey AS STRING)) ELSE NULL END AS invoice_number, CASE WHEN l_partkey % 6 = 0 THEN CAST(1 + l_suppkey % 4 AS STRING) ELSE NULL END AS grand_total_page, CASE WHEN l_partkey % 7 = 0 THEN 'Yes' ELSE NULL END AS has_grand_total,
 CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('$', CAST(CAST(CASE WHEN l_quantity < 30 THEN 100 ELSE 100 + l_suppkey % 3 END + CASE WHEN l_partkey % 2 = 0 THEN 0.02 ELSE 0.00 END AS DECIMAL(14,2)) AS STRING), ' CAD') END AS total,
 CASE WHEN l_suppkey % 3 = 0 THEN '0' ELSE CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) END AS amount, CASE WHEN l_partkey % 3 = 1 THEN CAST(CAST(floor(l_extendedprice) AS DECIMAL(14,2)) AS STRING) ELSE NULL END AS gst,
 concat('P', CAST(l_partkey AS STRING)) AS item, CASE WHEN l_suppkey % 11 = 0 THEN 'low' ELSE NULL END AS weak
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INT) AS batch FROM lineitem) x"""),
    # rows of hand-kept sheets: a section for each currency with its own column order, the first closed by a SUM row; a card sheet
    "bs": ("orders", """SELECT file, sheet, CAST(row_number() OVER (PARTITION BY file, sheet ORDER BY sec, kind, id) AS BIGINT) AS row, sec, kind, id, c1, c2, c3, c4, c5 FROM (
 SELECT file, sheet, sec, 1 AS kind, id, CASE WHEN sec = 1 THEN ymd ELSE typ END AS c1, CASE WHEN sec = 1 THEN typ WHEN sec = 2 THEN ymd ELSE ymd END AS c2, CASE WHEN sec = 2 THEN said ELSE money END AS c3, CASE WHEN sec = 2 THEN money ELSE said END AS c4, cat AS c5
 FROM (SELECT concat('b', CAST(o_custkey % 4 AS STRING), '-', CAST(year(o_orderdate) AS STRING)) AS file, CASE WHEN o_orderkey % 5 = 2 THEN 'Company card' ELSE 'Bank' END AS sheet, CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS sec, o_orderkey AS id,
   CASE WHEN o_orderkey % 29 = 0 THEN 'pending' ELSE concat(CAST(year(o_orderdate) AS STRING), lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), CASE WHEN o_orderkey % 2 = 0 THEN '.0' ELSE '' END) END AS ymd,
   CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'Credit' ELSE 'debit' END AS typ,
   CASE WHEN o_orderkey % 5 = 2 AND o_orderkey % 3 = 0 THEN concat('$', CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING), ' CR') ELSE concat(CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 2 THEN '-' ELSE '' END, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING)) END AS money,
   concat('Entry ', CAST(o_orderkey AS STRING)) AS said, CASE o_orderkey % 4 WHEN 0 THEN 'Bank fees' WHEN 1 THEN 'office supplies' WHEN 2 THEN ' Rent ' ELSE NULL END AS cat FROM orders WHERE o_orderkey % 5 < 3) x
 UNION ALL SELECT DISTINCT concat('b', CAST(o_custkey % 4 AS STRING), '-', CAST(year(o_orderdate) AS STRING)), CASE WHEN h.sec = 3 THEN 'Company card' ELSE 'Bank' END, h.sec, h.kind, CAST(0 AS BIGINT), h.c1, h.c2, h.c3, h.c4, h.c5 FROM orders,
  (SELECT 1 AS sec, 0 AS kind, 'Date Posted' AS c1, 'Transaction Type' AS c2, 'Transaction Amount (CAD)' AS c3, 'Description' AS c4, 'Category' AS c5 UNION ALL SELECT 1, 2, 'SUM', NULL, '1.00', NULL, NULL UNION ALL SELECT 1, 3, '20000101', 'DEBIT', '5.00', 'after the sum', NULL
   UNION ALL SELECT 2, 0, 'Transaction Type', 'Date Posted', 'Description', 'Transaction Amount USD', 'Category' UNION ALL SELECT 3, -1, 'made by hand', NULL, NULL, NULL, NULL UNION ALL SELECT 3, 0, 'Transaction Date', 'Posting Date', 'Transaction Amount', 'Description', 'Category') h) y"""),
    # lines of statement CSV files in all dialects, each with a comment above its header
    "cs": ("orders", """SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY k, id) - 1 AS BIGINT) AS row, value, id, kind FROM (
 SELECT concat(CASE kind WHEN 0 THEN 'cad' WHEN 1 THEN 'usd' WHEN 2 THEN 'card' WHEN 3 THEN 'wise' ELSE 'wallet' END, '-', CAST(u AS STRING), '.csv') AS file, 2 AS k, id, kind, CASE
  WHEN kind < 2 THEN concat('000,', CASE WHEN id % 3 = 0 THEN 'CREDIT' ELSE 'debit' END, ',', yyyy, mm, dd, ',', CASE WHEN id % 2 = 0 THEN concat('"$', amt, '"') ELSE concat('-', amt) END, ',"Shop, no. ', CAST(id AS STRING), '"')
  WHEN kind = 2 THEN concat(mm, '/', dd, '/', yyyy, ',', mm, '/', dd, '/', yyyy, ',Card shop,', CASE WHEN id % 3 = 0 THEN '-' ELSE '' END, amt, ',0000')
  WHEN kind = 3 THEN concat('W', CAST(id AS STRING), ',', CASE WHEN id % 4 = 0 THEN 'CANCELLED' ELSE 'completed' END, ',', CASE WHEN id % 3 = 0 THEN 'IN' ELSE 'OUT' END, ',', yyyy, '-', mm, '-', dd, ' 10:00:00,,', amt, ',USD,', amt, ',EUR,1.5,0,', CASE WHEN id % 2 = 0 THEN 'Invoice' ELSE '' END)
  ELSE concat(CASE WHEN id % 2 = 0 AND dd > '12' THEN concat(dd, '/', mm) ELSE concat(mm, '/', dd) END, '/', yyyy, ',10:00,UTC,Ann,', CASE WHEN id % 8 = 1 THEN 'Payment Hold' ELSE 'Express Checkout Payment' END, ',', CASE WHEN id % 9 = 0 THEN 'Pending' ELSE 'Completed' END, ',', CASE WHEN id % 6 = 0 THEN 'JPY' ELSE 'EUR' END, ',', CASE WHEN id % 3 = 0 THEN '' ELSE '-' END, amt, ',', CASE WHEN id % 7 = 0 THEN '-0.50' ELSE '0.00' END, ',,,T', CAST(id AS STRING)) END AS value
 FROM (SELECT o_orderkey AS id, o_orderkey % 5 AS kind, o_custkey % 4 AS u, CAST(year(o_orderdate) AS STRING) AS yyyy, lpad(CAST(month(o_orderdate) AS STRING), 2, '0') AS mm, lpad(CAST(day(o_orderdate) AS STRING), 2, '0') AS dd, CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS STRING) AS amt FROM orders) x
 UNION ALL SELECT DISTINCT concat(h.name, '-', CAST(o_custkey % 4 AS STRING), '.csv'), h.k, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), h.value FROM orders, (SELECT 'cad' AS name, 1 AS k, 'Account Number,Transaction Type,Date Posted,Transaction Amount,Description' AS value UNION ALL SELECT 'usd', 1, 'Account Number,Transaction Type,Date Posted,Transaction Amount,Description'
  UNION ALL SELECT 'card', 1, 'Transaction Date,Posting Date,Description,Amount,Card Number' UNION ALL SELECT 'wise', 1, 'ID,Status,Direction,Created on,Finished on,Source amount,Source currency,Target amount,Target currency,Exchange rate,Fee,Reference'
  UNION ALL SELECT 'wallet', 1, 'Date,Time,TimeZone,Name,Type,Status,Currency,Gross,Fee,Net,Subject,Transaction ID' UNION ALL SELECT 'cad', 0, '# made for tests' UNION ALL SELECT 'wallet', 0, '  ') h) y"""),
    # lines of marketplace order exports, both formats
    "oe": ("lineitem", """SELECT file, CAST(row_number() OVER (PARTITION BY file ORDER BY k, id, n, qty, price, day) - 1 AS BIGINT) AS row, value, k, id, n, qty, price, tax, day FROM (
 SELECT CASE WHEN id % 2 = 0 THEN 'privacy.csv' ELSE 'business.csv' END AS file, 1 AS k, *, CASE WHEN id % 2 = 0 THEN concat(CAST(id AS STRING), ',', day, ',', day, ',USD,', price, ',', tax, ',', qty, ',', CASE WHEN n % 3 = 0 THEN '' ELSE price END, ',', CASE WHEN n % 5 = 0 THEN 'Cancelled' ELSE 'Closed' END, ',"Thing ', CAST(n AS STRING), '"')
  ELSE concat(substr(day, 6, 2), '/', substr(day, 9, 2), '/', substr(day, 1, 4), ',', CAST(id AS STRING), ',B0,"Title, ', CAST(n AS STRING), '",', qty, ',', price, ',', tax, ',1.00,', CASE WHEN n % 2 = 0 THEN '0.10' ELSE '' END, ',', CASE WHEN n % 3 = 0 THEN '' ELSE concat('$', price) END, ',', CASE WHEN n % 5 = 0 THEN 'CANCELED' ELSE '' END, ',') END AS value
 FROM (SELECT l_orderkey AS id, l_linenumber AS n, CAST(CAST(l_quantity AS INT) AS STRING) AS qty, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS STRING) AS price, CAST(CAST(floor(l_quantity) AS DECIMAL(14,2)) AS STRING) AS tax, CAST(CAST(l_shipdate AS DATE) AS STRING) AS day FROM lineitem) x
 UNION ALL SELECT 'privacy.csv', 0, 0, 0, '', '', '', '', 'Order ID,Order Date,Shipment Date,Currency,Unit Price,Unit Price Tax,Quantity,Total Owed,Order Status,Product Name' UNION ALL SELECT 'business.csv', 0, 0, 0, '', '', '', '', 'Order Date,Order ID,ASIN,Title,Item Quantity,Purchase PPU,Federal Tax,Provincial Tax,Regulatory Fee,Item Net Total,Order Status,Currency Code') y"""),
    # rows of benchmark files: two blocks of columns, of which the second lost a quartile column in the second file
    "bf": ("customer", """SELECT concat('f', CAST(c_nationkey % 2 AS STRING)) AS file, c_custkey AS row, CAST(c_custkey % 900 + 100 AS STRING) AS a0, c_name AS a1, CAST(c_nationkey AS STRING) AS a2,
 CASE WHEN c_custkey % 17 = 0 THEN '9999' WHEN c_custkey % 13 = 0 THEN '..' ELSE CAST(CAST(abs(c_acctbal) / 100 AS DECIMAL(14,2)) AS STRING) END AS a3, CASE c_custkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN ' ' ELSE 'C' END AS a4,
 CAST(c_custkey % 10 AS STRING) AS a5, CAST(c_custkey % 20 AS STRING) AS a6, CAST(c_custkey % 30 AS STRING) AS a7, CAST(c_custkey % 40 AS STRING) AS a8, CAST(c_custkey % 50 AS STRING) AS a9, concat(CAST(c_custkey % 60 AS STRING), '%') AS a10
FROM customer"""),
    # quotes on every third day, of one currency from its third year only
    "fx": ("orders", """SELECT currency, day, CAST(1.20 + (sum(o_orderkey) % 3500) / 10000 AS DECIMAL(12,6)) AS rate FROM (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'EUR' END AS currency, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders) x
 WHERE day(day) % 3 = 0 AND (currency = 'USD' OR year(day) > 1996) GROUP BY currency, day"""),
    # a log of review actions on the matches of `m`, each loaded first
    "ev": ("orders", """SELECT m.user_id, m.transaction_id, a.seq, a.action, CASE WHEN a.seq = 4 THEN m.id + 10000000 WHEN a.seq = 5 THEN m.id + 20000000 ELSE m.id END AS match_id,
 CASE WHEN a.seq = 1 THEN m.document_id + 4 WHEN a.seq = 5 THEN m.document_id + 8 WHEN a.seq = 0 THEN m.document_id ELSE NULL END AS document_id, CASE WHEN a.seq = 1 THEN m.id + 10000000 ELSE NULL END AS new_match_id, CASE WHEN a.seq = 0 THEN m.status ELSE NULL END AS status, CAST(NULL AS STRING) AS reason
 FROM (SELECT o_orderkey AS id, o_custkey % 4 AS user_id, o_orderkey AS transaction_id, o_orderkey + 1000000 AS document_id, CASE o_orderkey % 10 WHEN 0 THEN 'USER_REJECTED' WHEN 2 THEN 'PENDING_REVIEW' WHEN 4 THEN 'USER_APPROVED' ELSE 'AUTO_APPROVED' END AS status FROM orders WHERE o_orderkey % 4 <> 3 AND o_orderkey % 2 = 0) m,
 (SELECT CAST(0 AS BIGINT) AS seq, 'LOAD' AS action, 1 AS k UNION ALL SELECT 1, 'REASSIGN', 3 UNION ALL SELECT 2, 'REMOVE_PROOF', 5 UNION ALL SELECT 4, 'SUPERSEDE', 7 UNION ALL SELECT 5, 'ADD_PROOF', 11) a WHERE m.id % a.k = 0"""),
}
# tenants of a few rows each: every customer is one
VIEW_SQL |= {f"{k}c": (source, sql.replace("o_custkey % 4 AS user_id", "o_custkey AS user_id")) for k, (source, sql) in VIEW_SQL.items() if k in "tr"}


class Views:
    """The views over one folder of tables, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _view(self, name: str) -> DataFrame:
        source, sql = VIEW_SQL[name]
        return self.spark.sql(sql.replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: self.table(source)})

    def _numbered(self, name: str, order: str, keep: str, span: int) -> DataFrame:
        """The view, its lines numbered from counts of short ranges of ids and then within a range: no task orders a file.

        order is what the SELECT numbers a file's lines by (k and id first), keep the columns it leaves out but for that.
        """
        source, sql = VIEW_SQL[name]
        number = f"CAST(row_number() OVER (PARTITION BY file ORDER BY {order}) - 1 AS BIGINT) AS row, "
        if number not in sql:
            raise ValueError(f"{name} is not numbered by {order}")
        rows = self.spark.sql(sql.replace(number, keep).replace(f"FROM {source}", f"FROM {{{source}}}"), **{source: self.table(source)})
        keys = ["file", "k", "_range"]
        rows = rows.withColumn("_range", F.floor(F.col("id") / span))
        before = Window.partitionBy("file").orderBy("k", "_range").rowsBetween(Window.unboundedPreceding, -1)
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
        own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order.split(", ")))
        return rows.withColumn("_own", own).join(F.broadcast(counts), keys).withColumn("row", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_range", "_own", "_before", *keep.replace(",", "").split())

    transactions = cached_property(lambda self: self._view("t"))
    receipts = cached_property(lambda self: self._view("r"))
    links = cached_property(lambda self: self._view("l"))
    chain_links = cached_property(lambda self: self._view("c"))
    matches = cached_property(lambda self: self._view("m"))
    jobs = cached_property(lambda self: self._view("j"))
    statement_lines = cached_property(lambda self: self._view("sl"))
    wallet_lines = cached_property(lambda self: self._view("wp"))
    page_batches = cached_property(lambda self: self._view("pb"))
    book_rows = cached_property(lambda self: self._view("bs"))
    csv_lines = cached_property(lambda self: self._numbered("cs", "k, id", "k, ", 65536))
    order_lines = cached_property(lambda self: self._numbered("oe", "k, id, n, qty, price, day", "", 2048))
    benchmark_rows = cached_property(lambda self: self._view("bf"))
    quotes = cached_property(lambda self: self._view("fx"))
    review_events = cached_property(lambda self: self._view("ev"))
    customer_transactions = cached_property(lambda self: self._view("tc"))
    customer_receipts = cached_property(lambda self: self._view("rc"))


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """An oracle query: the named views as common table expressions, then sql (which may go on with `, x AS (...)`)."""
    head = ",\n".join(f"{n} AS ({VIEW_SQL[n][1]})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
