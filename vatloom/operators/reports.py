"""Accounting reports: one disposition a document, numbered rows, subtotals by rate and a grand total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import report_date, report_money, vat_percent
from ..functions.textnorm import filled, slug
from . import rules as R
from .lists import reportable

FIELDS = ("InvoiceDate", "TotalAmount", "SubtotalAmount", "VatAmount", "SupplierName", "SupplierTaxCode", "Notes", "InvoiceNumber")
REVENUE, PURCHASE, SALES = "RevenueLedger", "PurchaseInvoiceList", "SalesInvoiceList"


def pivoted(fields: DataFrame, value: Column | None = None, names_of: tuple[str, ...] = FIELDS) -> DataFrame:
    """One row a document with each canonical field: the first non-blank of it and its aliases, from normalized values."""
    value = F.col("normalized_value") if value is None else value
    names = [n for f in names_of for n in (f, *R.ALIASES.get(f, ()))]
    wide = fields.where(F.col("field_name").isin(*names)).groupBy("doc_id").agg(*[F.max(F.when(F.col("field_name") == n, filled(value))).alias(n) for n in names])
    return wide.select("doc_id", *[F.coalesce(*[F.col(n) for n in (f, *R.ALIASES.get(f, ()))]).alias(f) for f in names_of])


def dispositions(documents: DataFrame, wide: DataFrame, start: Column, end: Column, kind: str = PURCHASE) -> DataFrame:
    """Each document (doc_id, updated_at) with its parsed values and what becomes of it: row, skipped for a reason, or outside the period."""
    d = documents.join(wide, "doc_id", "left").withColumns({"date": report_date(F.col("InvoiceDate")), "total": report_money(F.col("TotalAmount")), "subtotal": report_money(F.col("SubtotalAmount")), "vat": report_money(F.col("VatAmount"))})
    no_rate = F.col("subtotal").isNull() | (F.col("subtotal") <= 0) | F.col("vat").isNull()
    outcome = F.when(F.col("date").isNull(), "skipped: no date").when(~F.col("date").between(start, end), "outside").when(F.col("total").isNull(), "skipped: no total")
    if kind != REVENUE:
        outcome = outcome.when(no_rate, "skipped: no rate")
    party = (lambda c: F.col(c)) if kind == PURCHASE else (lambda c: F.lit(None).cast("string"))
    rate = vat_percent(F.col("vat"), F.col("subtotal")) if kind != REVENUE else F.lit(None).cast("int")
    return d.withColumns({
        "disposition": outcome.otherwise("row"), "rate": rate, "description": F.coalesce(filled(F.col("Notes")), F.col("SupplierName")),
        "counterparty": party("SupplierName"), "counterparty_tax_code": party("SupplierTaxCode"), "booking_date": F.to_date("updated_at"),
    })


def numbered(rows: DataFrame, by_rate: bool = True) -> DataFrame:
    """Sequence numbers across groups, by rate, date and number (nulls first).

    Numbers run over the whole report of one client and period, so they are counted in two steps:
    inside each (rate, date), and over the counts of these days.
    """
    key = ["rate", "date"] if by_rate else ["date"]
    days = rows.groupBy(*key).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"d.{k}")) for k in key]
    cond = same[0] if len(same) == 1 else same[0] & same[1]
    joined = rows.alias("r").join(days.withColumn("before", before).alias("d"), cond).select("r.*", "before")
    return joined.withColumn("seq", F.col("before") + F.row_number().over(Window.partitionBy(*key).orderBy("InvoiceNumber", "doc_id"))).drop("before")


def totals(rows: DataFrame) -> DataFrame:
    """Subtotals by rate and the grand total (rate null, is_total), which is there for an empty report too."""
    z = lambda c: F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("decimal(38,2)").alias(c)
    amounts = ("subtotal", "vat", "total")
    per = rows.groupBy("rate").agg(F.lit(False).alias("is_total"), F.count("*").alias("n"), *[z(c) for c in amounts])
    whole = per.agg(F.lit(None).cast("int").alias("rate"), F.lit(True).alias("is_total"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"), *[z(c) for c in amounts])
    return per.unionByName(whole)


def report_file_name(client: Column, kind: str, start: Column, end: Column) -> Column:
    return F.concat(slug(client), F.lit(f"_{kind}_"), F.date_format(start, "yyyyMM"), F.lit("-"), F.date_format(end, "yyyyMM"), F.lit(".xlsx"))


# Why a document is left out of a report, and the labels of sums.
REASONS = {
    "skipped: no date": "Thiếu hoặc không đọc được ngày hóa đơn.",
    "skipped: no total": "Thiếu tổng thanh toán.",
    "skipped: no rate": "Không xác định được thuế suất (thiếu giá trị chưa thuế hoặc tiền thuế).",
}
SUM_OF_RATE, SUM_OF_LEDGER, GRAND_TOTAL = "Cộng %d%%:", "Cộng phát sinh:", "TỔNG CỘNG"


def sheet(rows: DataFrame, kind: str = PURCHASE) -> DataFrame:
    """The lines of a report's sheet in the order of ``line``: numbered rows, for the lists each rate's sum after its rows, and
    the grand total, which an empty report has too. Amounts of a ledger are its totals alone."""
    listed = kind != REVENUE
    sums, none = totals(rows), F.lit(None)
    place = lambda rate, step, seq: F.struct(F.coalesce(rate, F.lit(1 << 30)).cast("long").alias("rate"), F.lit(step).alias("step"), seq.cast("long").alias("seq"))
    money = lambda c: F.col(c).cast("decimal(38,2)").alias(c)
    percent = F.when(F.col("rate").isNotNull(), F.concat(F.col("rate").cast("string"), F.lit("%")))
    amounts = [money(c) if listed or c == "total" else none.cast("decimal(38,2)").alias(c) for c in ("subtotal", "vat", "total")]
    own = F.col("rate") if listed else F.lit(0)
    party = ("counterparty", "counterparty_tax_code") if listed else ("booking_date", "description")
    each = numbered(rows, listed).select(place(own, 0, F.col("seq")).alias("line"), F.col("seq").cast("long").alias("seq"), F.col("InvoiceNumber").alias("document_number"), F.col("date").alias("document_date"), *[F.col(c).cast("string").alias(c) for c in party], *amounts, percent.alias("vat_rate"), none.cast("string").alias("label"))
    label = F.when(~F.col("is_total"), F.format_string(SUM_OF_RATE, F.col("rate"))).otherwise(GRAND_TOTAL if listed else SUM_OF_LEDGER)
    below = sums if listed else sums.where("is_total")
    blank = [none.cast("long").alias("seq"), none.cast("string").alias("document_number"), none.cast("date").alias("document_date"), *[none.cast("string").alias(c) for c in party]]
    step = F.when(F.col("is_total"), F.lit(2)).otherwise(F.lit(1))
    return each.unionByName(below.select(place(F.when(F.col("is_total"), F.lit(1 << 30)).otherwise(F.col("rate")), 1, step).alias("line"), *blank, *amounts, none.cast("string").alias("vat_rate"), label.alias("label")))


def skipped_sheet(disposed: DataFrame) -> DataFrame:
    """file_name and reason of what a report leaves out, in order of upload (``line``)."""
    out = disposed.where(F.col("disposition").startswith("skipped"))
    reason = F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("disposition")]
    return out.select(F.struct("created_at", "doc_id").alias("line"), "file_name", reason.alias("reason"))


def report(documents: DataFrame, fields: DataFrame, org_id: int, client_id: int, start: Column, end: Column, kind: str = PURCHASE) -> tuple[DataFrame, DataFrame]:
    """The sheet and the skipped documents of one client's report, from all documents (doc_id, org_id, client_id, status, file_name,
    created_at, updated_at) and fields. The client's few documents are found first and sent to the fields, if they are few."""
    mine = reportable(documents, org_id, client_id)
    theirs = fields.join(mine.select("doc_id"), "doc_id", "left_semi")
    disposed = dispositions(mine, pivoted(theirs), start, end, kind)
    return sheet(disposed.where("disposition = 'row'"), kind), skipped_sheet(disposed)
