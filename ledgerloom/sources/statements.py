"""Bank statements: CSV dialects and statement text, all to one row shape.

Columns: account, transaction_type, date_posted, amount (decimal text), currency, description, source_file, source_row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X
from ..operators.cut import written

CURRENCIES = ["CAD", "USD", "CNY", "EUR", "GBP"]
WALLET_SKIP = ["General Currency Conversion", "Bank Deposit to PP Account", "User Initiated Withdrawal", "Account Hold for Open Authorization", "Reversal of General Account Hold", "Payment Hold"]
FEW_FILES = 10_000
OUT = ["account", "transaction_type", "date_posted", "amount", "currency", "description", "source_file", "source_row"]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, value): lines that are neither blank nor comments; the row number is the line's place in its file."""
    whole = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), _decoded(F.col("content")).alias("text"))
    out = whole.select("file", F.posexplode(F.split("text", "\r?\n")).alias("row", "value"))
    return out.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))


def _decoded(content: Column) -> Column:
    """UTF-8 with a byte-order mark removed, Latin-1 where it is not UTF-8."""
    utf = F.try_validate_utf8(content.cast("string")) if hasattr(F, "try_validate_utf8") else F.decode(content, "UTF-8")
    return F.regexp_replace(F.coalesce(utf, F.decode(content, "ISO-8859-1")), "^﻿", "")


def dialect(header: Column) -> Column:
    """Dialect of a header line; the order of the tests matters."""
    h = F.lower(header)
    return (
        F.when(h.contains("transaction type") & h.contains("date posted"), "chequing").when(h.contains("posting date") & h.contains("card"), "card")
        .when(h.contains("source amount") & h.contains("target amount"), "wise").when(h.contains("gross") & h.contains("net") & h.contains("transaction id"), "paypal")
        .when(h.contains("order id") & h.contains("shipment"), "market_privacy").when(h.contains("order date") & h.contains("asin"), "market_business").otherwise("unsupported")
    )


def account_of(file: Column) -> Column:
    """Account from a file name: card, then USD, then CAD."""
    f = F.lower(file)
    return F.when(f.rlike("card|credit|mastercard|visa"), "CreditCard").when(f.contains("usd"), "USD").when(f.contains("cad"), "CAD")


def _cells(value: Column) -> Column:
    """Cells of a CSV line (quotes may hold commas)."""
    raw = F.regexp_extract_all(value, F.lit(r'("(?:[^"]|"")*"|[^,]*)(?:,|$)'), F.lit(1))
    return F.transform(raw, lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"')))


def table(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, dialect, cells as a map of header to value) of every data line."""
    return parsed(lines(spark, path))


def parsed(rows: DataFrame) -> DataFrame:
    """(file, row, dialect, cells) of data lines (file, row, value) of any number of files; blank lines and comments are none."""
    rows = rows.where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    head = rows.groupBy("file").agg(F.min_by("value", "row").alias("head"), F.min("row").alias("head_row"))
    names = F.transform(F.transform(_cells(F.col("head")), F.lower), lambda x, i: F.when(x == "", F.concat(F.lit("_"), i.cast("string"))).otherwise(x))
    head = written(head.select("file", "head_row", dialect(F.col("head")).alias("dialect"), names.alias("names")), "heads")
    if head.count() <= FEW_FILES:  # lines of few files are not gathered by file
        head = F.broadcast(head)
    # exploded, so that a line is split once
    out = rows.join(head, "file").where("row > head_row").select("file", "row", "dialect", "names", F.explode(F.array(_cells(F.col("value")))).alias("values"))
    n = F.least(F.size("names"), F.size("values"))
    return out.select("file", "row", "dialect", F.map_from_arrays(F.slice("names", F.lit(1), n), F.slice("values", F.lit(1), n)).alias("c"))


def _get(name: str) -> Column:
    return F.col("c")[name]


def _shape(df: DataFrame, account: Column, kind: Column, date: Column, amount: Column, currency: Column, description: Column) -> DataFrame:
    out = df.select(
        account.alias("account"), kind.alias("transaction_type"), F.date_format(date, "yyyy-MM-dd").alias("date_posted"), amount.cast(S.MONEY).cast("string").alias("amount"), currency.alias("currency"),
        F.trim(description).alias("description"), F.col("file").alias("source_file"), F.col("row").cast("long").alias("source_row"),
    )
    return out.where("date_posted is not null and amount is not null")


def chequing(rows: DataFrame, account: str | None = None) -> DataFrame:
    own = F.lit(account) if account else F.coalesce(account_of(F.col("file")), F.lit("CAD"))
    r = rows.where("dialect = 'chequing'")
    return _shape(r, own, F.upper(_get("transaction type")), F.try_to_date(_get("date posted"), "yyyyMMdd"), S.clean_amount(_get("transaction amount")), F.when(own == "USD", "USD").otherwise("CAD"), _get("description"))


def card(rows: DataFrame) -> DataFrame:
    amount = S.clean_amount(_get("amount"))
    return _shape(rows.where("dialect = 'card'"), F.lit("CreditCard"), F.when(amount < 0, "CREDIT").otherwise("DEBIT"), F.try_to_date(_get("posting date"), "MM/dd/yyyy"), amount, F.lit("CAD"), _get("description"))


def wise(rows: DataFrame) -> DataFrame:
    r = rows.where("dialect = 'wise' and upper(c['status']) = 'COMPLETED'")
    out = F.upper(_get("direction")) == "OUT"
    amount = S.clean_amount(_get("source amount"))
    text = F.concat_ws(" ", S.nullif_blank(_get("reference")), F.concat(F.lit("("), _get("source currency"), F.lit(" -> "), _get("target amount"), F.lit(" "), _get("target currency"), F.lit(" @ "), _get("exchange rate"), F.lit(")")))
    return _shape(r, F.lit("Wise"), F.when(out, "DEBIT").otherwise("CREDIT"), F.try_to_date(F.substring(_get("created on"), 1, 10)), F.when(out, -amount).otherwise(amount), _get("source currency"), text)


def wallet(rows: DataFrame) -> DataFrame:
    r = rows.where("dialect = 'paypal' and lower(c['status']) = 'completed'").where(~_get("type").isin(WALLET_SKIP) & _get("currency").isin(CURRENCIES))
    gross = S.clean_amount(_get("gross"))
    fee = S.clean_amount(_get("fee"))
    text = F.array_join(F.array_compact(F.array(S.nullif_blank(_get("name")), S.nullif_blank(_get("subject")), S.nullif_blank(_get("type")), F.when(fee != 0, F.concat(F.lit("fee "), fee.cast("string"))))), " — ")
    return _shape(r.where(gross != 0), F.lit("PayPal"), F.when(gross < 0, "DEBIT").otherwise("CREDIT"), S.wallet_date(_get("date")), gross, _get("currency"), text)


def read(spark: SparkSession, path: str, account: str | None = None) -> DataFrame:
    """All supported statement files under path; a file of no known dialect is an error."""
    return every(table(spark, path), account)


def every(rows: DataFrame, account: str | None = None) -> DataFrame:
    """Ledger rows of parsed lines, which are written once for all dialects; a file of no known dialect is an error."""
    rows = written(rows, "lines")
    bad = [r.file for r in rows.where("dialect = 'unsupported'").select("file").distinct().limit(5).collect()]
    if bad:
        raise ValueError(f"unsupported statement format: {', '.join(sorted(bad))}")
    out = chequing(rows, account)
    for more in (card(rows), wise(rows), wallet(rows)):
        out = out.unionByName(more)
    return out


# statement text


def card_text(texts: DataFrame) -> DataFrame:
    """Card lines `MMM d MMM d text 12.34 [CR]`; a month after the closing month is of the year before. texts: file, text, year, month."""
    line = F.explode(F.split("text", "\n"))
    p = r"^\s*([A-Z][a-z]{2})\.?\s+(\d{1,2})\s+([A-Z][a-z]{2})\.?\s+(\d{1,2})\s+(.+?)\s+([\d,]+\.\d{2})\s*(CR)?\s*$"
    rows = texts.select("file", "year", "month", F.posexplode(F.split("text", "\n")).alias("row", "line")).where(F.col("line").rlike(p))
    del line
    g = lambda k: F.regexp_extract("line", p, k)
    at = F.try_to_date(F.concat_ws(" ", g(3), g(4), F.col("year").cast("string")), "MMM d yyyy")
    at = F.when(F.month(at) > F.col("month"), F.add_months(at, -12)).otherwise(at)
    credit = g(7) == "CR"
    amount = S.clean_amount(g(6))
    return _shape(rows, F.lit("CreditCard"), F.when(credit, "CREDIT").otherwise("DEBIT"), at, F.when(credit, -amount).otherwise(amount), F.lit("CAD"), g(5))


def chequing_text(texts: DataFrame) -> DataFrame:
    """Lines `MMMdd text a [b]`: the last amount is the balance; a credit iff the balance rose. texts: file, text, year, month."""
    p = r"^\s*([A-Z][a-z]{2})\s?(\d{1,2})\s+(.+?)\s+([\d,]+\.\d{2})\s+([\d,]+\.\d{2})\s*$"
    rows = texts.select("file", "year", "month", F.posexplode(F.split("text", "\n")).alias("row", "line")).where(F.col("line").rlike(p))
    g = lambda k: F.regexp_extract("line", p, k)
    w = Window.partitionBy("file").orderBy("row")
    rows = rows.withColumn("balance", S.clean_amount(g(5))).withColumn("before", F.lag("balance").over(w))
    hint = S.any_match(g(3), ["deposit", "credit", "interest earned", "incoming"])
    credit = F.when(F.col("before").isNull(), hint).otherwise(F.col("balance") > F.col("before"))
    at = F.try_to_date(F.concat_ws(" ", g(1), g(2), F.col("year").cast("string")), "MMM d yyyy")
    at = F.when(F.month(at) > F.col("month"), F.add_months(at, -12)).otherwise(at)
    amount = S.clean_amount(g(4))
    return _shape(rows, F.lit("CAD"), F.when(credit, "CREDIT").otherwise("DEBIT"), at, F.when(credit, amount).otherwise(-amount), F.lit("CAD"), g(3))


def looks_like_statement(text: Column) -> Column:
    """Two of five signals in a text of 120 characters or more with ten ledger lines or more."""
    n = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"\d{1,2}.*\d+\.\d{2}\s*(CR)?\s*$")))
    signals = [S.any_match(text, [p]) for p in ("opening balance", "closing balance", r"statement (period|date)", r"account (number|no)", r"(total|sum of) (debits|credits|withdrawals|deposits)")]
    return (F.length(text) >= 120) & (n >= 10) & (sum(s.cast("int") for s in signals) >= 2)


# payloads


def model_rows(payload: DataFrame) -> DataFrame:
    """Rows of a model's statement payload: key aliases, type from the sign, absolute two-place amount, empty rows dropped. payload: file, json."""
    items = payload.select("file", F.posexplode(F.from_json(F.get_json_object(S.unfenced("json"), "$.transactions"), "array<map<string,string>>")).alias("row", "m"))
    pick = lambda *names: F.coalesce(*[F.nullif(F.trim(F.col("m")[n]), F.lit("")) for n in names])
    value = S.bracketed_money(pick("amount", "amt", "value"))
    kind = F.upper(F.coalesce(pick("type", "transaction_type"), F.when(value < 0, F.lit("DEBIT")).otherwise(F.lit("CREDIT"))))
    return items.select("file", "row", F.date_format(S.first_date(pick("date", "date_posted", "posted"), S.MARKET_FORMATS), "yyyy-MM-dd").alias("date"), F.abs(value).cast(S.MONEY).cast("string").alias("amount"), kind.alias("type"), pick("description", "desc", "memo").alias("description")).where("amount is not null or description is not null")


def api_rows(details: DataFrame) -> DataFrame:
    """Wallet API details to rows: settled ones of allowed event codes; key is the hash of id and code. details: info struct columns id, status, code, amount, currency, at, name, email, subject."""
    code = F.coalesce("code", F.lit(""))
    allowed = (code == "") | (code == "T1201") | ~code.rlike("^T(02|20|21|13|98|12)")
    amount = S.money("amount")
    host = F.initcap(F.split_part(F.split_part("email", F.lit("@"), F.lit(2)), F.lit("."), F.lit(1)))
    who = F.coalesce(S.nullif_blank("name"), S.nullif_blank("subject"), S.nullif_blank(host), F.lit("PayPal"))
    return details.where((F.col("status") == "S") & allowed & (amount != 0)).select(
        F.lit("PayPal").alias("account"), F.when(amount < 0, "DEBIT").otherwise("CREDIT").alias("transaction_type"), F.substring("at", 1, 10).alias("date_posted"), amount.cast("string").alias("amount"), "currency", who.alias("description"),
        S.stable_hash(F.concat_ws(":", "id", code)).alias("source_row"),
    )


def generic_text(texts: DataFrame, year: int) -> DataFrame:
    """Lines `date text amount` of any statement, in the first of three date layouts that at least two lines of the file have; a date without a year is of `year`. texts: file, text."""
    amount = r"\s+(.+?)\s+(-?\$?[\d,]+\.\d{2})\s*$"
    layouts = [r"(\d{4}[-/]\d{2}[-/]\d{2})", r"([A-Z][a-z]{2}\s+\d{1,2},?\s+\d{4})", r"(\d{1,2}/\d{1,2}(?:/\d{2,4})?)"]
    rows = texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("row", "line"))
    hits = F.array_compact(F.array(*[F.when(F.col("line").rlike(d + amount), F.lit(k)) for k, d in enumerate(layouts)]))
    found = rows.select("file", "row", "line", F.explode(hits).alias("layout"))
    used = found.groupBy("file", "layout").agg(F.count("*").alias("n")).where("n >= 2").groupBy("file").agg(F.min("layout").alias("layout"))
    rows = found.join(used, ["file", "layout"])
    part = lambda k: F.element_at(F.array(*[F.regexp_extract("line", d + amount, k) for d in layouts]), F.col("layout") + 1)
    date = F.regexp_replace(F.trim(part(1)), r"\s+", " ")
    dated = F.when(date.rlike(r"^\d{1,2}/\d{1,2}$"), F.concat(date, F.lit(f"/{year}"))).otherwise(date)
    value = S.clean_amount(part(3))
    at = S.first_date(dated, ["yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "M/d/yy", "MMM d, yyyy", "MMM d yyyy"])
    return _shape(rows, F.coalesce(account_of(F.col("file")), F.lit("CAD")), F.when(value < 0, "DEBIT").otherwise("CREDIT"), at, value, F.lit("CAD"), part(2))


def first_reading(*readings: DataFrame) -> DataFrame:
    """The ladder of readers: a file's rows come from the first reading that has any."""
    out = readings[0]
    for later in readings[1:]:
        out = out.unionByName(later.join(out.select("source_file").distinct(), "source_file", "left_anti"))
    return out


def fee_labelled(kind: Column, description: Column) -> Column:
    """Fee rows of the transfer service read as fees: a prefix goes before texts that the bank-charge rule doesn't know."""
    known = S.any_match(description, [p for name, _, ps in X.CATEGORY_RULES if name == "Interest and bank charges" for p in ps])
    fee = F.upper(F.trim(F.coalesce(kind, F.lit("")))).isin(X.FEE_TYPES) & (description != "")
    return F.when(fee & ~known, F.concat(F.lit(X.FEE_PREFIX), description)).otherwise(description)


def transfer_service(payload: DataFrame, currency: str = "USD") -> DataFrame:
    """Rows of the transfer service's statement JSON (column json): type from the sign, description or reference as text, the key a hash of the reference or the row's number."""
    row = "struct<type:string,date:string,referenceNumber:string,amount:struct<value:decimal(18,2),currency:string>,details:struct<type:string,description:string>>"
    items = payload.select(F.posexplode(F.from_json("json", f"struct<transactions:array<{row}>>").getField("transactions")).alias("n", "t"))
    ref, value = S.nullif_blank("t.referenceNumber"), F.coalesce("t.amount.value", F.lit(0).cast(S.MONEY))
    text = F.coalesce(S.nullif_blank("t.details.description"), ref, F.concat(F.lit("Wise transaction "), F.coalesce("t.type", F.lit(""))))
    return items.select(
        F.lit("Wise").alias("account"), F.when(value >= 0, "CREDIT").otherwise("DEBIT").alias("transaction_type"), F.substring("t.date", 1, 10).alias("date_posted"), value.cast("string").alias("amount"),
        F.coalesce("t.amount.currency", F.lit(currency)).alias("currency"), fee_labelled(F.col("t.details.type"), text).alias("description"), F.lit("wise_api").alias("source_file"),
        F.when(ref.isNotNull(), S.stable_hash(ref)).otherwise(F.col("n") + 1).cast("long").alias("source_row"),
    )
