"""Hand-kept workbooks as rows of cells: stacked currency sections, card sheets, and benchmark files with labelled columns.

Input is one row a sheet row: file, sheet, row, cells (texts as a reader of workbooks prints them; empty cells are null).
A header opens a section and a row with SUM closes it; what stands between is read by the header's own columns. That is
one pass over a sheet in row order, and sheets are bounded by their format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import tables as X

CELLS = "file string, sheet string, row long, cells array<string>"
OUT = ["account", "transaction_type", "date_posted", "amount", "description", "category", "invoice", "note", "file", "sheet", "row"]


def kind(sheet: Column) -> Column:
    """card, sections, or null for sheets that hold no rows of an account."""
    name = F.lower(sheet)
    has = lambda words: S.any_of([name.contains(w) for w in words])
    return F.when(has(X.SHEETS_SKIPPED), None).when(has(X.CARD_SHEETS), "card").when(has(X.SECTION_SHEETS), "sections")


def _labels(cells: Column) -> Column:
    return F.transform(cells, lambda c: F.lower(F.trim(F.coalesce(c, F.lit("")))))


def _is_header(cells: Column, keywords: list[str]) -> Column:
    """Three of the keywords or more in the first eight cells, the first of which isn't empty."""
    some = _labels(F.slice(cells, 1, 8))
    found = lambda word: F.exists(some, lambda c: c.contains(word)).cast("int")
    return F.get(cells, F.lit(0)).isNotNull() & (sum(map(found, keywords), F.lit(0)) >= 3)


def _place(head: Column, test) -> Column:
    """Place of the last label that passes, from 0."""
    at = F.array_position(F.reverse(F.transform(head, test)), True)
    return F.when(at > 0, F.size(head) - at.cast("int"))


def _date(c: Column) -> Column:
    """yyyymmdd as a number or text, or a timestamp."""
    c = F.trim(c)
    return F.coalesce(F.try_to_date(F.when(c.rlike(r"^\d{8}(\.0+)?$"), F.substring(c, 1, 8)), "yyyyMMdd"), F.try_to_date(F.when(c.rlike(r"^\d{4}-\d\d-\d\d([ T].*)?$"), F.substring(c, 1, 10)), "yyyy-MM-dd"))


def _amount(c: Column) -> Column:
    """Figures with dollar signs and commas; a trailing ` CR` is negative."""
    bare = F.regexp_replace(F.trim(c), "[$,]", "")
    back = F.upper(bare).endswith(" CR")
    value = F.when(back, F.trim(F.regexp_replace(bare, "(?i) CR$", ""))).otherwise(bare).try_cast(S.MONEY)
    return F.when(back, -value).otherwise(value)


def _currency(head: Column) -> Column:
    """The currency that a section's header names: by the first cell that names one."""
    one = lambda c: F.coalesce(*[F.when(F.lower(c).contains(x.lower()), x) for x in X.SECTION_CURRENCIES])
    return F.coalesce(F.get(F.array_compact(F.transform(head, one)), F.lit(0)), F.lit(X.SECTION_CURRENCIES[0]))


def _read(rows: DataFrame, labels: Column, account: Column, date_at: Column, by_sign: bool, categories: dict[str, str]) -> DataFrame:
    get = lambda at: F.get(F.col("cells"), at)
    exact = lambda word: _place(labels, lambda h: h == word)
    with_ = lambda *words: _place(labels, lambda h: S.any_of([h.contains(w) for w in words]))
    text = lambda at: F.coalesce(F.trim(get(at)), F.lit(""))
    amount = _amount(get(with_("transaction amount")))
    own = F.when(amount < 0, "CREDIT").otherwise("DEBIT") if by_sign else F.coalesce(F.upper(F.trim(get(with_("transaction type")))), F.when(amount < 0, "DEBIT").otherwise("CREDIT"))
    # a label is read as the first of these it fits, so an invoice column named after a category is a category
    category = text(with_("category"))
    invoice = text(_place(labels, lambda h: S.any_of([h.contains(w) for w in (("invoice",) if by_sign else ("invoice", "cheque"))]) & ~h.contains("category")))
    note = text(_place(labels, lambda h: h.contains("note") & ~S.any_of([h.contains(w) for w in ("category", "invoice", *(() if by_sign else ("cheque",)))])))
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])[category], category) if categories else category
    out = rows.select(account.alias("account"), own.alias("transaction_type"), F.date_format(_date(get(date_at)), "yyyy-MM-dd").alias("date_posted"), amount.cast("string").alias("amount"), text(exact("description")).alias("description"), named.alias("category"), invoice.alias("invoice"), note.alias("note"), "file", "sheet", "row")
    return out.where("date_posted is not null and amount is not null")


def section_rows(sheet_rows: DataFrame, categories: dict[str, str] = X.CATEGORY_SPELLINGS) -> DataFrame:
    """Rows of stacked sections; the account is the currency of the section's header. Rows before a header or after SUM are no data."""
    cells = F.col("cells")
    closes = F.exists(F.slice(cells, 1, 4), lambda c: F.coalesce(F.upper(c).contains("SUM"), F.lit(False)))
    opens = ~closes & _is_header(cells, X.SECTION_HEADER)
    mark = F.when(closes, F.struct(F.lit(False).alias("open"), cells.alias("head"))).when(opens, F.struct(F.lit(True).alias("open"), cells.alias("head")))
    before = F.last("mark", ignorenulls=True).over(Window.partitionBy("file", "sheet").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    rows = sheet_rows.where("cells is not null").withColumn("mark", mark).withColumn("before", before).where("mark is null and before.open").withColumn("head", _labels(F.col("before.head")))
    head = F.col("head")
    date_at = _place(head, lambda h: h.contains("date posted") & ~h.contains("transaction type"))
    return _read(rows, head, _currency(F.col("before.head")), date_at, False, categories)


def card_rows(sheet_rows: DataFrame, categories: dict[str, str] = X.CATEGORY_SPELLINGS) -> DataFrame:
    """Rows of card sheets after their first header: a positive amount is a charge, dated by posting where there is such a column."""
    first = sheet_rows.where(_is_header(F.col("cells"), X.CARD_HEADER)).groupBy("file", "sheet").agg(F.min(F.struct("row", "cells")).alias("h"))
    rows = sheet_rows.join(first, ["file", "sheet"]).where("row > h.row").withColumn("head", _labels(F.col("h.cells")))
    head = F.col("head")
    date_at = F.coalesce(_place(head, lambda h: h.contains("posting date")), _place(head, lambda h: h.contains("transaction date")))
    return _read(rows, head, F.lit("CreditCard"), date_at, True, categories)


def read(sheet_rows: DataFrame, categories: dict[str, str] = X.CATEGORY_SPELLINGS) -> DataFrame:
    """All rows of accounts in some workbooks, each sheet read as its name says."""
    rows = sheet_rows.withColumn("_kind", kind(F.col("sheet")))
    return section_rows(rows.where("_kind = 'sections'"), categories).unionByName(card_rows(rows.where("_kind = 'card'"), categories))


# benchmark files: blocks of columns found by their labels


def _label(cell: Column) -> Column:
    """First line of a header cell that isn't blank, in lower case and single spaces."""
    lines = F.transform(F.split(F.coalesce(cell, F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(F.lower(x), r"\s+", " ")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), F.lit(""))


def percentage(c: Column) -> Column:
    """A share in hundredths; marks of suppression and figures of 9999 or more are null."""
    value = F.regexp_replace(F.trim(c), "[,% ]", "").try_cast("double")
    return F.when(value < 9999, value / 100)


def _with_header(rows: DataFrame) -> DataFrame:
    """Data rows with the labels of their file's first row."""
    head = rows.groupBy("file").agg(F.min_by("cells", "row").alias("h"), F.min("row").alias("first"))
    return rows.join(head, "file").where("row > first").withColumn("h", F.transform("h", _label)).drop("first")


def benchmark_lines(rows: DataFrame) -> DataFrame:
    """(file, row, naics, province, bucket, pct, quality, q1..q4) of benchmark files, rows: file, row, cells.

    A block begins at the first column whose label names a bucket (or the net margin); its quality and four quartile
    columns are taken only where their own labels are those expected, so a moved column is null, not misread.
    """
    names = F.create_map(*[F.lit(x) for kv in X.BENCHMARK_LINES.items() for x in kv])
    r = _with_header(rows)
    starts = F.transform(F.col("h"), lambda x, i: F.struct(names[x].alias("bucket"), i.alias("at"), F.array_position(F.col("h"), x).alias("first")))
    block = F.explode(F.filter(starts, lambda s: s["bucket"].isNotNull() & (s["first"] == s["at"] + 1)))
    r = r.select("file", "row", F.trim(F.get("cells", F.lit(0))).alias("naics"), F.trim(F.get("cells", F.lit(2))).alias("province"), "cells", "h", block.alias("b"))
    at = F.col("b.at")
    label = lambda k: F.coalesce(F.get("h", at + k), F.lit(""))
    fits = F.lit(True)
    for k, word in enumerate(X.QUARTILE_LABELS):
        fits = fits & label(k + 2).contains(word)
    cell = lambda k: F.get("cells", at + k)
    quality = F.when(label(1).contains("quality"), S.nullif_blank(cell(1)))
    return r.select("file", "row", "naics", "province", "b.bucket", percentage(cell(0)).alias("pct"), quality.alias("quality"), *[F.when(fits, percentage(cell(k + 2))).alias(f"q{k + 1}") for k in range(4)])


def benchmark_revenue(rows: DataFrame) -> DataFrame:
    """(file, row, naics, province, businesses, quality, low1, high1, ... low4, high4) of revenue files; the count stands in the fourth column if no label names it. Dollars are thousands in the file."""
    r = _with_header(rows)
    find = lambda *words: _first_label(F.col("h"), *words)
    cell = lambda at: F.regexp_replace(F.trim(F.get("cells", at)), "[,$ ]", "").try_cast("double")
    real = lambda c: F.when(~c.isin(99999.9, 999999.0), c)
    sides = [real(cell(find(q, f"{side} revenue range"))) * 1000 for q in X.QUARTILE_LABELS for side in ("low", "high")]
    names = [f"{side}{k}" for k in range(1, 5) for side in ("low", "high")]
    count = real(cell(F.coalesce(find("whole industry", "reliability"), F.lit(3))))
    return r.select("file", "row", F.trim(F.get("cells", F.lit(0))).alias("naics"), F.trim(F.get("cells", F.lit(2))).alias("province"), count.cast("long").alias("businesses"), S.nullif_blank(F.get("cells", find("quality indicator"))).alias("quality"), *[c.alias(n) for c, n in zip(sides, names, strict=True)])


def _first_label(head: Column, *words: str) -> Column:
    """Place of the first label with all the words, from 0; null if none."""
    at = F.array_position(F.transform(head, lambda h: sum((h.contains(w).cast("int") for w in words), F.lit(0)) == len(words)), True)
    return F.when(at > 0, at.cast("int") - 1)
