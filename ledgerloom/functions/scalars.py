"""Scalar expressions: money, currency, dates and text. All are Column -> Column and stay in the JVM."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as X

MONEY = "decimal(18,2)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    """Decimal text at rest; what does not parse is null."""
    return col(c).try_cast(MONEY)


def guarded_money(c: Column | str) -> Column:
    """Figures from extraction: plain decimals only, anything else counts as 0."""
    return F.when(col(c).rlike(r"^-?[0-9]+(\.[0-9]+)?$"), col(c).try_cast(MONEY)).otherwise(F.lit(0).cast(MONEY))


def clean_amount(c: Column | str) -> Column:
    """Statement amounts: quotes, dollar signs and thousands separators go; blank is 0."""
    bare = F.regexp_replace(F.trim(col(c)), '[",$ ]', "")
    return F.when(bare == "", F.lit(0).cast(MONEY)).otherwise(bare.try_cast(MONEY))


def bracketed_money(c: Column | str) -> Column:
    """Amounts of hand-kept sheets: `$`, commas, (1.00) and a trailing CR are read; CR and brackets are negative."""
    text = F.upper(F.trim(col(c).cast("string")))
    minus = text.rlike(r"^\(.*\)$") | text.rlike(r"CR$")
    bare = F.regexp_replace(text, r"[$,() ]|CR$", "").try_cast(MONEY)
    return F.when(minus, -F.abs(bare)).otherwise(bare)


def money_text(c: Column) -> Column:
    return F.format_string("%.2f", F.coalesce(c, F.lit(0)).cast("decimal(18,2)").cast("double"))


def half_even(c: Column, places: int) -> Column:
    return F.bround(c, places)


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


# dates


def first_date(c: Column | str, formats: list[str]) -> Column:
    """The first of the formats that reads the text."""
    return F.coalesce(*[F.try_to_date(F.trim(col(c)), f) for f in formats]) if formats else F.lit(None).cast("date")


MARKET_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "dd/MM/yyyy", "yyyy/MM/dd", "MMM d, yyyy", "MMMM d, yyyy"]


def wallet_date(c: Column | str) -> Column:
    """ISO, else a/b/yyyy: day first when a > 12, month first otherwise."""
    c = F.trim(col(c))
    a = F.split_part(c, F.lit("/"), F.lit(1)).try_cast("int")
    return F.coalesce(F.try_to_date(F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), F.substring(c, 1, 10)), "yyyy-M-d"), F.when(a > 12, F.try_to_date(c, "d/M/yyyy")).otherwise(F.try_to_date(c, "M/d/yyyy")))


def month(c: Column | str) -> Column:
    return F.substring(col(c), 1, 7)


def day_gap(a: Column | str, b: Column | str) -> Column:
    """Absolute gap in days; 1,000,000 when either is missing."""
    return F.coalesce(F.abs(F.datediff(F.try_to_date(col(a)), F.try_to_date(col(b)))), F.lit(1_000_000))


def filename_month(c: Column | str) -> Column:
    """The 15th of a month named in a file name (yyyy-MM, MM-yyyy or month name and year), 2020 to 2030."""
    name = F.lower(col(c))
    short = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
    word = F.regexp_extract(name, r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ _-]*(20[0-9]{2})", 1)
    word_year = F.regexp_extract(name, r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*[ _-]*(20[0-9]{2})", 2)
    iso, rev = r"(20[0-9]{2})[-_]([01][0-9])(?![0-9])", r"(?<![0-9])([01][0-9])[-_](20[0-9]{2})"
    tries = [
        (F.regexp_extract(name, iso, 1), F.regexp_extract(name, iso, 2)),
        (F.regexp_extract(name, rev, 2), F.regexp_extract(name, rev, 1)),
        (word_year, F.array_position(F.array(*map(F.lit, short)), word).cast("string")),
    ]
    dates = [F.when(y.try_cast("int").between(2020, 2030) & m.try_cast("int").between(1, 12), F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lit("15")))) for y, m in tries]
    return F.coalesce(*dates)


# text


def normal(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]", "")


def nullif_blank(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def any_match(c: Column | str, patterns: list[str]) -> Column:
    return F.coalesce(col(c).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def first_match(c: Column | str, rules: list[tuple[list[str], object]], default=None) -> Column:
    """The value of the first rule one of whose patterns occurs, ignoring case."""
    out = reduce(lambda acc, rule: acc.when(any_match(c, rule[0]), F.lit(rule[1])), rules[1:], F.when(any_match(c, rules[0][0]), F.lit(rules[0][1])))
    return out.otherwise(F.lit(default)) if default is not None else out


def strip_prefix(c: Column | str) -> Column:
    """A payment processor's action goes from the front, unless the action is all there is."""
    bare = F.trim(F.regexp_replace(col(c), "(?i)" + X.PROCESSOR_PREFIX, ""))
    return F.when(any_match(c, [p for p, _ in X.PROCESSOR_ACTIONS]) | (bare == ""), col(c)).otherwise(bare)


def vendor_key(c: Column | str) -> Column:
    """Stable key of a merchant from a bank description; '' if nothing is left."""
    raw = F.trim(F.coalesce(col(c), F.lit("")))
    text = F.trim(F.regexp_replace(raw, "(?i)" + X.PROCESSOR_PREFIX, ""))
    for p in (r"\b\d{6,}\b", r"\*[A-Z0-9]+", r"#\d+", r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{2,4}\b", r"(?i)\s+[A-Z]\b", "(?i)" + X.NOISE_TOKENS):
        text = F.regexp_replace(text, p, " ")
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")

    def keyed(head: Column) -> Column:
        slug = F.slice(F.filter(F.split(F.regexp_replace(head, "[^a-z0-9]+", "_"), "_"), lambda t: t != ""), 1, 2)
        return F.coalesce(first_match(head, [([p], k) for p, k in X.VENDOR_ALIASES]), F.array_join(slug, "_"))

    return F.coalesce(first_match(raw, [([p], k) for p, k in X.PROCESSOR_ACTIONS]), let(F.lower(F.array_join(F.slice(tokens, 1, 3), " ")), keyed))


def crude_slug(c: Column | str) -> Column:
    return F.substring(F.regexp_replace(F.trim(F.lower(F.coalesce(col(c), F.lit("")))), "[^a-z0-9]+", "_"), 1, 32)


def csv_safe(c: Column | str) -> Column:
    """A cell that a spreadsheet would read as a formula gets an apostrophe; numbers don't."""
    c = col(c)
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[+-]?[0-9][0-9,]*(\.[0-9]+)?$"), F.concat(F.lit("'"), c)).otherwise(c)


def stable_hash(c: Column) -> Column:
    """First 15 hexadecimal digits of MD5 as a number."""
    return F.conv(F.substring(F.md5(c), 1, 15), 16, 10).cast("long")


def like_escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), "_+", "_")


def month_label(c: Column | str) -> Column:
    return F.date_format(F.to_date(col(c)), "MMMyyyy")


def word_confidence(c: Column | str) -> Column:
    return F.when(F.lower(F.trim(col(c))) == "high", 0.9).when(F.lower(F.trim(col(c))) == "medium", 0.6).when(F.lower(F.trim(col(c))) == "low", 0.3)


def unfenced(c: Column | str) -> Column:
    """Model output without its code fence."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(col(c)), "^```[a-zA-Z]*\\s*", ""), "\\s*```$", ""))


# currency


def currency_code(c: Column | str) -> Column:
    up = F.upper(F.trim(col(c)))
    return F.when(up.rlike("^[A-Z]{3}$"), up)


def tax_signal(gst: Column, hst: Column, pst: Column, subtotal: Column) -> Column:
    """Canadian sales tax on a document: a non-zero tax, or a rate within 0.3 points of a known one."""
    total = F.coalesce(gst, F.lit(0)) + F.coalesce(hst, F.lit(0)) + F.coalesce(pst, F.lit(0))
    rate = F.when(F.abs(subtotal) > 0, (total * 100 / subtotal).cast("double"))
    near = F.exists(F.array(*[F.lit(float(r)) for r in X.CANADIAN_TAX_RATES]), lambda x: F.abs(rate - x) <= 0.3)
    return (total != 0) | F.coalesce(near & (total != 0), F.lit(False))


def resolved_currency(code: Column, source: Column, signal: Column) -> Column:
    """struct(currency, source): stated, else inferred from Canadian tax, else the code as it is, else unknown."""
    code, source = currency_code(code), F.lower(F.trim(source))

    def out(c, s):
        return F.struct(c.alias("currency"), F.lit(s).alias("source"))

    return (
        F.when((source == "stated") & code.isNotNull(), out(code, "stated"))
        .when(signal & (code == "CAD") & source.isNull(), out(F.lit("CAD"), "stated"))
        .when(signal, out(F.lit("CAD"), "inferred"))
        .when(code.isNotNull() & source.isNull(), out(code, "stated"))
        .when((source == "inferred") & code.isNotNull(), out(code, "inferred"))
        .otherwise(out(F.lit(None).cast("string"), "assumed"))
    )


def marker_currency(c: Column | str) -> Column:
    """Currency that a printed marker names; a bare dollar names none."""
    t = F.upper(F.trim(col(c)))
    return (
        F.when(t.rlike(r"^(CAD|CA\$|C\$|CDN\$?|CAN\$)$"), "CAD").when(t.rlike(r"^(USD|US\$|U\.S\.\$)$"), "USD").when(t.isin("EUR", "€"), "EUR")
        .when(t.isin("GBP", "£"), "GBP").when(t.isin("CNY", "RMB", "CN¥"), "CNY").when(t.isin("JPY", "AUD", "CHF", "NZD", "SEK", "NOK", "DKK"), t)
    )


def text_currency(c: Column | str) -> Column:
    """The one currency that all markers of a text agree on, else null."""
    found = F.regexp_extract_all(F.upper(col(c)), F.lit(r"(CA\$|C\$|CDN|US\$|\b(?:CAD|USD|EUR|GBP|CNY|RMB|JPY|AUD|CHF)\b|€|£)"), F.lit(1))
    codes = F.array_distinct(F.array_compact(F.transform(found, marker_currency)))
    return F.when(F.size(codes) == 1, F.element_at(codes, 1))


def fx_rate(c: Column | str) -> Column:
    """A rate printed as AT1.2345 or @1.2345, between 0.5 and 3."""
    at = F.regexp_extract(col(c), r"AT(\d+\.\d{2,6})", 1).try_cast("double")
    sign = F.regexp_extract(col(c), r"@(\d+\.\d{2,10})", 1).try_cast("double")
    ok = lambda r: F.when((r > 0.5) & (r < 3.0), r)
    return F.coalesce(ok(at), ok(sign))


def usd_in_text(c: Column | str) -> Column:
    return F.regexp_extract(col(c), r"(?i)USD\s*([0-9][0-9,]*\.[0-9]{2})@", 1).try_cast(MONEY)


# tax


def jurisdiction(description: Column, vendor: Column) -> Column:
    """CA, FOREIGN or UNKNOWN, from country codes, region tokens and the trailing place code of a memo."""
    text = F.concat_ws(" ", description, vendor)
    tokens = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9$.]+"), F.lit(0)), lambda t: F.upper(F.regexp_replace(t, r"^[.$]+|[.$]+$", ""))), lambda t: t != "")
    lit = lambda xs: F.array(*map(F.lit, xs))
    country = F.try_element_at(F.filter(tokens, lambda t: F.array_contains(lit([*X.FOREIGN_COUNTRIES, "CAN"]), t)), F.lit(1))
    last = F.try_element_at(tokens, F.lit(-1))
    tail = F.when(F.length(last) == 2, last).when((F.length(last) >= 5) & last.rlike("^[A-Z]+$"), F.substring(last, -2, 2))
    return F.when(F.size(tokens) == 0, "UNKNOWN").otherwise(
        F.when(country == "CAN", "CA").when(country.isNotNull(), "FOREIGN").when(F.arrays_overlap(tokens, lit(X.FOREIGN_REGIONS)), "FOREIGN")
        .when(tail.isin(X.PROVINCES), "CA").when(tail.isin(X.US_STATES), "FOREIGN").otherwise("UNKNOWN")
    )


def tax_code(category: Column, kind: Column, place: Column, shows_tax: Column, linked: Column) -> Column:
    """struct(code, basis) for an export row; a tax claim needs tax on the linked document."""
    def out(code, basis):
        return F.struct(F.lit(code).alias("code"), F.lit(basis).alias("basis"))

    foreign = place == "FOREIGN"
    income = (
        F.when(shows_tax, out("GST on Income", "tax collected on the linked document"))
        .when(foreign, out("Zero-rated / No GST", "non-resident payer"))
        .when(linked, out("", "linked document shows no tax"))
        .otherwise(out("", "no sales document linked"))
    )
    expense = (
        F.when(shows_tax, out("GST on Expenses", "tax on the linked document"))
        .when(foreign, out("Zero-rated / No GST", "non-resident supplier"))
        .when(linked, out("", "linked document shows no tax"))
        .otherwise(out("", "no document linked"))
    )
    return (
        F.when(kind.isNull() & category.isNull(), F.when(foreign, out("", "uncategorized, non-resident")).otherwise(out("", "uncategorized")))
        .when(kind.isNull(), out("", "uncategorized"))
        .when(category == "Owner's draw", out("BAS Excluded", "owner distribution"))
        .when(kind == "transfer", out("BAS Excluded", "own accounts"))
        .when(kind == "tax", out("BAS Excluded", "remittance"))
        .when(kind == "equity", out("BAS Excluded", "owner distribution"))
        .when(kind == "contra", out("", "refund follows the original supply"))
        .when(kind == "income", income)
        .otherwise(expense)
    )


# extraction payloads


def alternate_amount(raw: Column | str, total: Column | str) -> Column:
    """The second amount of a payload (`amount`), positive and other than the total's magnitude; null without a total."""
    text = F.regexp_replace(F.trim(F.get_json_object(payload_json(raw), "$.amount")), "[$, ]", "")
    value = text.try_cast(MONEY)
    return F.when((value > 0) & (value != F.abs(money(total))), value)


def payload_json(raw: Column | str) -> Column:
    """A payload as JSON: texts that start like JSON are left alone, others have their single quotes turned."""
    return F.when(col(raw).rlike(r"^[{\[]\s*('|$)"), F.translate(col(raw), "'", '"')).when(col(raw).rlike(r"^[{\[]"), col(raw)).otherwise(F.translate(col(raw), "'", '"'))


def payment_date(raw: Column | str, method: Column | str, document_date: Column | str) -> Column:
    """Date of payment: the payload's `payment_date`, then `on February 02[, 2024]` or an ISO date in the method's text. A day without a year is of the document's year."""
    stated = F.try_to_date(F.get_json_object(payload_json(raw), "$.payment_date"), "yyyy-MM-dd")
    at = r"(?i)(?:on|by|date:?)\s*([a-z]+)\s+(\d{1,2})(?:,?\s*(\d{4}))?"
    year = F.coalesce(nullif_blank(F.regexp_extract(col(method), at, 3)), F.substring(col(document_date).cast("string"), 1, 4))
    spelled = F.concat_ws(" ", F.initcap(F.regexp_extract(col(method), at, 1)), F.regexp_extract(col(method), at, 2), year)
    named = F.coalesce(F.try_to_date(spelled, "MMMM d yyyy"), F.try_to_date(spelled, "MMM d yyyy"))
    return F.coalesce(stated, named, F.try_to_date(F.regexp_extract(col(method), r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd"))


def filename_hint(c: Column | str) -> Column:
    """The 15th of the month that a file's name tells (Dec2026, 2026 Dec, Dec252026), 2020 to 2030; the first of the three that is there and in range."""
    name, mon = F.coalesce(col(c), F.lit("")), "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    tries = [(rf"(?i){mon}\s*(\d{{4}})", 1, 2), (rf"(?i)(\d{{4}})\s+{mon}", 2, 1), (rf"(?i){mon}\d{{1,2}}(\d{{4}})", 1, 2)]
    at = lambda m: F.lpad(F.array_position(F.array(*map(F.lit, X.MONTHS)), F.lower(m)).cast("string"), 2, "0")
    dates = []
    for p, m, y in tries:
        month_text, year = F.regexp_extract(name, p, m), F.regexp_extract(name, p, y).try_cast("int")
        dates.append(F.when(year.between(2020, 2030), F.try_to_date(F.concat_ws("-", year, at(month_text), F.lit("15")))))
    return F.when(name.rlike(f"(?i){mon}"), F.coalesce(*dates))


def best_date(raw: Column | str, method: Column | str, document_date: Column | str, filename: Column | str) -> Column:
    """The date a receipt is compared by: that of payment, else its own; a file name's month that is one or two months later wins, or stands alone."""
    own = F.coalesce(payment_date(raw, method, document_date), F.try_to_date(col(document_date).cast("string")))

    def chosen(x: Column) -> Column:
        later = (F.year(x["hint"]) - F.year(x["own"])) * 12 + F.month(x["hint"]) - F.month(x["own"])
        return F.when(later.between(1, 2), x["hint"]).otherwise(F.coalesce(x["own"], x["hint"]))

    return let(F.struct(own.alias("own"), filename_hint(filename).alias("hint")), chosen)


def line_items_text(items: Column | str) -> Column:
    """Up to five line items as `2x name (amount); ...`, 200 characters at most; text that is no list of items is cut alone."""
    parsed = F.from_json(col(items), "array<map<string,string>>")
    pick = lambda m, *names: F.coalesce(*[nullif_blank(m[n]) for n in names])

    def piece(m: Column) -> Column:
        name, amount = F.coalesce(pick(m, "description", "name"), F.lit("")), pick(m, "amount", "total", "price")
        counted = F.when(pick(m, "quantity").isNotNull() & (name != ""), F.concat(m["quantity"], F.lit("x "), name)).otherwise(name)
        return F.when(amount.isNull(), counted).when(counted == "", amount).otherwise(F.concat(counted, F.lit(" ("), amount, F.lit(")")))

    pieces = F.filter(F.transform(F.slice(parsed, 1, 5), piece), lambda x: x != "")
    return F.substring(F.when(F.trim(col(items)).startswith("["), F.array_join(pieces, "; ")).otherwise(F.coalesce(col(items), F.lit(""))), 1, 200)


def extraction_verdict(total: Column | str, amount: Column | str, subtotal: Column | str, taxes: list[Column | str]) -> Column:
    """struct(valid, total, mismatch): valid with a total or an amount that is a figure (zero included); mismatch where subtotal and taxes are off by more than .02."""
    zero, number = F.lit(0).cast(MONEY), lambda c: F.coalesce(money(c), F.lit(0).cast(MONEY))
    own, sub = number(total), number(subtotal)
    stated = F.coalesce(F.trim(col(total)).isin("0", "0.0", "0.00"), F.lit(False)) | F.coalesce(F.trim(col(amount)).isin("0", "0.0", "0.00"), F.lit(False))
    used = F.when(own != zero, own).otherwise(number(amount))
    off = F.abs(own - sub - reduce(lambda a, b: a + b, [number(t) for t in taxes], zero)) > F.lit("0.02").cast(MONEY)
    return F.struct(((used != zero) | stated).alias("valid"), used.cast(MONEY).alias("total"), ((sub != zero) & (own != zero) & off).alias("mismatch"))


def previous_period(start: datetime.date, end: datetime.date) -> tuple[datetime.date, datetime.date]:
    """The month before a calendar month; otherwise as many days, ending the day before."""
    day = datetime.timedelta(days=1)
    if start.day == 1 and (start.year, start.month) == (end.year, end.month) and (end + day).month != end.month:
        return (start - day).replace(day=1), start - day
    return start - day - (end - start), start - day
