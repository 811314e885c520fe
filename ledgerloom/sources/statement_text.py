"""Statements as extracted text and tables: what a file is, and its rows.

Input is one row a page: file, page, text, tables (rows of cells). What holds for a whole file (account, wallet or bank,
order of day and month, year) is decided from all its pages first and joined back; then rows are read. Files are small
and many: whatever is ordered here is ordered within one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X
from . import statements as T

PAGES = "file string, page int, text string, tables array<array<array<string>>>"
FACTS = ["account", "is_wallet", "date_order", "is_business", "year", "month", "from_year"]


def account_type(text: Column) -> Column:
    """CreditCard, USD or CAD, by words of the text."""
    t = F.lower(text)
    card = (t.contains("cashback") & t.contains("mastercard")) | (t.contains("credit card") & t.contains("posting date"))
    dollars = t.contains("us$") | t.contains("usd") | t.contains("u.s. dollar")
    return F.when(card, "CreditCard").when(dollars & (F.replace(t, F.lit(" "), F.lit("")).contains("accounttype:usd") | t.contains("us$business")), "USD").otherwise("CAD")


def is_wallet(text: Column) -> Column:
    t = F.lower(text)
    return t.contains("paypal") & (t.contains("transaction history") | t.contains("activity statement") | t.contains("merchant account id"))


def date_order(text: Column) -> Column:
    """dmy or mdy by the first date of the text that can only be read one way; null where none decides."""
    part = lambda d, k: F.split_part(d, F.lit("/"), F.lit(k)).cast("int")
    said = F.transform(F.regexp_extract_all(text, F.lit(r"(\d{1,2})/(\d{1,2})/(\d{4})"), F.lit(0)), lambda d: F.when(part(d, 1) > 12, "dmy").when(part(d, 2) > 12, "mdy"))
    return F.get(F.array_compact(said), F.lit(0))


def _month(name: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(m) for m in X.MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("int"))


def _year(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, "(?id)" + pattern, 1).try_cast("int")


def facts(pages: DataFrame, year: int | None = None, default_order: str = "dmy") -> DataFrame:
    """(file, text, FACTS): a file's text in page order and what it says of the whole file.

    A wallet's dates are day first unless its first unambiguous date says otherwise. A file without a year is of `year`,
    the current one if none is given.
    """
    whole = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    text = F.col("text")
    whole = whole.select("file", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    default = F.lit(year) if year is not None else F.year(F.current_date())
    card = F.coalesce(_year(text, r"statement\s+(?:date|period)\s+.*?(\d{4})"), default)
    bank = F.coalesce(_year(text, r"(?:period ending|statement)\s+.*?(\d{4})"), default)
    start = _year(text, r"statement\s+period\s+\w+\.?\s+\d+,?\s+(\d{4})\s*-")
    ends = F.coalesce(_month(F.regexp_extract(text, r"(?id)period ending\s+(\w+)\s+\d+,?\s+(\d{4})", 1)), F.lit(12))
    out = whole.withColumn("account", account_type(text)).withColumn("is_wallet", is_wallet(text)).withColumn("date_order", F.coalesce(date_order(text), F.lit(default_order)))
    is_card = F.col("account") == "CreditCard"
    return out.select("file", "text", "account", "is_wallet", "date_order", S.any_match(text, X.BUSINESS_STATEMENT).alias("is_business"), F.when(is_card, card).otherwise(bank).alias("year"), ends.alias("month"), F.when(is_card, F.coalesce(start, card)).otherwise(bank).alias("from_year"))


def _places(df: DataFrame, *by: str) -> DataFrame:
    """Numbers a file's rows from 1 in the order of `by`."""
    return df.withColumn("row", F.row_number().over(Window.partitionBy("file").orderBy(*by)))


_AMOUNT = r"(-?[\d,]+\.\d{2})"
LINE = rf"(?md)^([A-Z][a-z]{{2}})(\d{{2}})\s+(.+?)\s+{_AMOUNT}(?:\s+{_AMOUNT})?(?:\s+{_AMOUNT})?\s*$"
CARD_LINE = r"(?md)^([A-Z][a-z]{2,8})\.?\s+(\d{1,2})\s*([A-Z][a-z]{2,8})\.?\s+(\d{1,2})\s+(.+?)\s+([\d,]+\.\d{2})(?:\s+(CR))?\s*$"


def balance_rows(files: DataFrame) -> DataFrame:
    """Rows of `MonDD text amount balance` lines; files: file, text, account, year, month, is_business.

    The last of two or three amounts is the balance after the line. Whether money came or went is told by its change
    against the last balance known: that of the line before, over lines that print none, or the opening balance; before
    any, by words of the text. A line of three amounts prints the debit first. Months after the closing month are of the
    year before. Totals, items and lines of one amount are no rows and leave the balance as it is.
    """
    g = lambda k: F.regexp_extract("m", LINE, k)
    found = files.where("is_business").select("file", "account", "year", "month", F.posexplode(F.regexp_extract_all("text", F.lit(LINE), F.lit(0))).alias("row", "m"))
    amounts = F.filter(F.array(g(4), g(5), g(6)), lambda x: x != "")
    rows = found.withColumn("text", g(3)).withColumn("a", F.transform(amounts, S.clean_amount)).withColumn("mon", _month(g(1))).withColumn("dd", g(2))
    bare = F.replace(F.lower("text"), F.lit(" "), F.lit(""))
    opening = bare.contains("openingbalance")
    summary = F.exists(F.array(*map(F.lit, X.STATEMENT_TOTALS)), lambda x: bare.contains(x))
    fits = ~summary & F.col("mon").isNotNull() & (F.size("a") >= 2)
    rows = rows.withColumn("fits", ~opening & fits).withColumn("balance", F.when(opening | F.col("fits"), F.element_at("a", -1)))
    before = F.last("balance", ignorenulls=True).over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    hint = F.exists(F.array(*map(F.lit, X.CREDIT_HINTS)), lambda x: F.upper("text").contains(x))
    came = F.when(F.size("a") == 3, False).when(before.isNotNull(), F.col("balance") > before).otherwise(hint)
    rows = rows.withColumn("came", came).where("fits")
    year = F.col("year") - F.when(F.col("mon") > F.col("month"), 1).otherwise(0)
    at = F.try_to_date(F.concat_ws("-", year, F.lpad(F.col("mon").cast("string"), 2, "0"), "dd"))
    value = F.when(F.size("a") == 3, F.col("a")[0]).otherwise(F.abs(F.col("a")[0]))
    return T._shape(rows, F.col("account"), F.when(F.col("came"), "CREDIT").otherwise("DEBIT"), at, F.when(F.col("came"), value).otherwise(-value), F.when(F.col("account") == "USD", "USD").otherwise("CAD"), F.regexp_replace(F.trim("text"), ",+$", ""))


def card_rows(files: DataFrame) -> DataFrame:
    """Rows of card lines `Mon d Mon d text amount [CR]`, dated by posting; December is of the period's first year."""
    g = lambda k: F.regexp_extract("m", CARD_LINE, k)
    rows = files.where("account = 'CreditCard'").select("file", "year", "from_year", F.posexplode(F.regexp_extract_all("text", F.lit(CARD_LINE), F.lit(0))).alias("row", "m"))
    mon = _month(g(3))
    rows = rows.where(~S.any_match(g(5), ["subtotal", "total for card"]) & mon.isNotNull())
    year = F.when(mon == 12, F.col("from_year")).otherwise(F.col("year"))
    at = F.try_to_date(F.concat_ws("-", year, F.lpad(mon.cast("string"), 2, "0"), F.lpad(g(4), 2, "0")))
    amount, back = S.clean_amount(g(6)), g(7) == "CR"
    return T._shape(rows, F.lit("CreditCard"), F.when(back, "CREDIT").otherwise("DEBIT"), at, F.when(back, -amount).otherwise(amount), F.lit("CAD"), g(5))


def _header(table: Column) -> Column:
    return F.transform(table[0], lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))


def _has(header: Column, *words: str) -> Column:
    return F.exists(header, lambda h: S.any_of([h.contains(w) for w in words]))


def _first(header: Column, *words: str) -> Column:
    """Place of the first label with one of the words, from 0; null if none."""
    at = F.array_position(F.transform(header, lambda h: S.any_of([h.contains(w) for w in words])), True)
    return F.when(at > 0, at.cast("int") - 1)


def _cell(at: Column, row: str = "cells") -> Column:
    return F.trim(F.coalesce(F.get(F.col(row), at), F.lit("")))


def sections(text: Column) -> Column:
    """Currencies of the section headers of a page, in order."""
    return F.array_compact(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.when(x.contains("Transaction History - USD"), "USD").when(x.contains("Transaction History - CAD"), "CAD")))


def wallet_tables(pages: DataFrame) -> DataFrame:
    """(file, page, n, table, currency) of a wallet's transaction tables (with a date and a gross column).

    The k-th table of a page stands in the k-th section of the page, or the last one. A page without section headers goes
    on with the currency that the page before ended in: that of its section after its last table. Files begin in CAD.
    """
    ok = lambda t: (F.size(t) >= 2) & _has(_header(t), "date") & _has(_header(t), "gross")
    p = pages.select("file", "page", sections(F.col("text")).alias("s"), F.coalesce(F.filter("tables", ok), F.array().cast("array<array<array<string>>>")).alias("t"))
    at = lambda k: F.get("s", F.least(k, F.size("s") - 1))
    ended = F.when(F.size("s") > 0, at(F.size("t")))
    carried = F.coalesce(F.last(ended, ignorenulls=True).over(Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit("CAD"))
    p = p.withColumn("carried", carried)
    return p.select("file", "page", "s", "carried", F.posexplode("t").alias("n", "table")).select("file", "page", "n", "table", F.coalesce(F.when(F.size("s") > 0, at(F.col("n"))), F.col("carried")).alias("currency"))


def wallet_rows(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Ledger rows of the wallet's tables, their dates read in the file's order. files: file, date_order."""
    t = wallet_tables(pages).join(files.select("file", "date_order"), "file")
    first = _first(F.col("h"), "date")
    kind = lambda h, i: F.when(h.contains("date") & (i == first), "date").when(h.contains("description"), "desc").when(h.contains("name") | h.contains("email"), "name").when(h.contains("gross"), "gross").when(h.contains("fee"), "fee")
    t = t.withColumn("h", _header(F.col("table"))).withColumn("k", F.transform("h", kind))
    rows = t.select("file", "page", "n", "currency", "date_order", "k", F.posexplode(F.slice("table", F.lit(2), F.size("table"))).alias("r", "cells"))
    last = lambda name: F.when(F.array_contains("k", name), F.size("k") - F.array_position(F.reverse("k"), name).cast("int"))
    cell = lambda name: _cell(last(name))
    parts = F.split(cell("date"), "/")
    month_at = F.when(F.col("date_order") == "dmy", 1).otherwise(0)
    iso = F.when(F.size(parts) == 3, F.concat_ws("-", F.lpad(F.trim(parts[2]), 4, "0"), F.lpad(F.trim(parts[month_at]), 2, "0"), F.lpad(F.trim(parts[1 - month_at]), 2, "0")))
    line = lambda c: F.trim(F.split_part(c, F.lit("\n"), F.lit(1)))
    rows = _places(rows.withColumn("iso", iso).where(F.try_to_date("iso", "yyyy-MM-dd").isNotNull()), "page", "n", "r")
    empty = F.lit("")
    c = F.create_map(*[x for k, v in {"status": F.lit("Completed"), "date": F.col("iso"), "type": line(cell("desc")), "name": line(cell("name")), "subject": empty, "gross": cell("gross"), "fee": cell("fee"), "currency": F.col("currency"), "transaction id": F.regexp_extract(cell("desc"), r"ID:\s*(\S+)", 1)}.items() for x in (F.lit(k), v)])
    return T.wallet(rows.select("file", "row", F.lit("paypal").alias("dialect"), c.alias("c")))


def table_rows(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Rows of bank tables with a date and an amount, or a debit and a credit column. files: file, account."""
    debit, credit = ("debit", "withdrawal"), ("credit", "deposit")
    ok = lambda t: (F.size(t) >= 2) & _has(_header(t), "date") & ((_has(_header(t), *debit) & _has(_header(t), *credit)) | _has(_header(t), "amount"))
    t = pages.select("file", "page", F.posexplode(F.filter("tables", ok)).alias("n", "table")).join(files.select("file", "account"), "file").withColumn("h", _header(F.col("table")))
    at = _first(F.col("h"), "date")
    said = F.coalesce(_first(F.col("h"), "description", "details", "transaction"), F.when(at + 1 < F.size("h"), at + 1))
    rows = t.select("file", "account", "page", "n", "h", at.alias("at"), said.alias("said"), _first(F.col("h"), "amount").alias("amt"), _first(F.col("h"), *debit).alias("deb"), _first(F.col("h"), *credit).alias("cre"), F.posexplode(F.slice("table", F.lit(2), F.size("table"))).alias("r", "cells"))
    money = lambda c: F.when(_cell(F.col(c)) != "", S.clean_amount(_cell(F.col(c))))
    single = F.col("amt").isNotNull() & (F.col("amt") < F.size("cells"))
    value = F.when(single, money("amt")).when(F.col("deb").isNotNull() & F.col("cre").isNotNull(), F.coalesce(-money("deb"), money("cre")))
    went = F.when(single, money("amt") < 0).otherwise(money("deb").isNotNull())
    day = S.first_date(_cell(F.col("at")), X.STATEMENT_DATES)
    rows = _places(rows.withColumn("value", value).withColumn("went", went).withColumn("day", day).where("day is not null and value is not null"), "page", "n", "r")
    return T._shape(rows, F.col("account"), F.when(F.col("went"), "DEBIT").otherwise("CREDIT"), F.col("day"), F.col("value"), F.when(F.col("account") == "USD", "USD").otherwise("CAD"), F.when(F.col("said").isNull(), "").otherwise(_cell(F.col("said"))))


def read(pages: DataFrame, year: int | None = None) -> DataFrame:
    """Rows of extracted statements: wallets by their tables, cards by their lines, other accounts by the first of tables, balance lines and generic lines that gives a row."""
    files = facts(pages, year)
    own = pages.join(files.select("file", "account", "is_wallet"), "file")
    bank = files.where("not is_wallet and account <> 'CreditCard'")
    out = T.first_reading(
        table_rows(own.where("not is_wallet and account <> 'CreditCard'").select("file", "page", "text", "tables"), files),
        balance_rows(bank),
        T.generic_text(bank.select("file", "text"), year if year is not None else 1970),
    )
    return wallet_rows(own.where("is_wallet").select("file", "page", "text", "tables"), files).unionByName(card_rows(files.where("not is_wallet"))).unionByName(out)
