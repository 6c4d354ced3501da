"""Checks on fields that a language model claims: a value counts only if its source text occurs in the document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import date_loose, money, tax_code, vat_rate
from ..functions.textnorm import blank, squeeze

AMOUNTS = ("SubtotalAmount", "VatAmount", "TotalAmount")


def verified(claims: DataFrame) -> DataFrame:
    """Claims (doc_id, field_name, value, source_text, full_text) with ``outcome``: absent (null value), rejected, or kept; and the confidence of kept ones."""
    found = ~blank(F.col("source_text")) & F.contains(squeeze(F.col("full_text")), squeeze(F.col("source_text")))
    outcome = F.when(blank(F.col("value")), "absent").when(F.coalesce(found, F.lit(False)), "kept").otherwise("rejected")
    f, v = F.col("field_name"), F.col("value")
    weak = (
        F.when(f.isin("InvoiceDate", "DueDate"), date_loose(v).isNull())
        .when(f.isin("SupplierTaxCode", "BuyerTaxCode"), ~F.coalesce(F.length(tax_code(v)).isin(10, 13), F.lit(False)))
        .when(f.isin(*AMOUNTS), money(v).isNull())
        .otherwise(F.lit(False))
    )
    out = claims.withColumn("outcome", outcome)
    return out.withColumn("confidence", F.when(F.col("outcome") == "kept", F.when(weak, 0.5).otherwise(0.9)))


def rejects(checked: DataFrame) -> DataFrame:
    return checked.groupBy("doc_id").agg(F.count_if(F.col("outcome") == "rejected").alias("rejected"))


def reconciled(kept: DataFrame) -> DataFrame:
    """Kept fields with confidence 0.5 on all three amounts where subtotal + tax differs from the total by more than 1."""
    pick = lambda n: F.max(F.when(F.col("field_name") == n, money(F.col("value"))))
    gap = kept.groupBy("doc_id").agg((F.abs(pick("SubtotalAmount") + pick("VatAmount") - pick("TotalAmount")) > 1).alias("off"))
    lowered = F.when(F.coalesce("off", F.lit(False)) & F.col("field_name").isin(*AMOUNTS), F.lit(0.5)).otherwise(F.col("confidence"))
    return kept.join(gap, "doc_id", "left").withColumn("confidence", lowered).drop("off")


def tax_lines(lines: DataFrame) -> DataFrame:
    """Claimed rate lines (doc_id, line_no, rate, taxable, tax, full_text): incomplete ones are dropped, those whose amounts don't occur in the text are rejected, the rest renumbered."""
    whole = lines.where(~blank(F.col("rate")) & ~blank(F.col("taxable")) & ~blank(F.col("tax")))
    text = squeeze(F.col("full_text"))
    ok: Column = F.contains(text, squeeze(F.col("taxable"))) & F.contains(text, squeeze(F.col("tax")))
    kept = whole.where(F.coalesce(ok, F.lit(False)))
    per = kept.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("line_no", "rate", "taxable", "tax"))).alias("ls"))
    each = per.select("doc_id", F.posexplode("ls").alias("sort_order", "l"))
    return each.select("doc_id", "sort_order", F.col("l.rate").alias("raw_rate"), vat_rate(F.col("l.rate")).alias("vat_rate"), money(F.col("l.taxable")).cast("decimal(18,2)").alias("taxable_amount"), money(F.col("l.tax")).cast("decimal(18,2)").alias("tax_amount"))


def first_success(attempts: DataFrame) -> DataFrame:
    """The outcome of each document (doc_id, strategy, priority, success, payload): the first strategy by priority that succeeded."""
    return attempts.where("success").groupBy("doc_id").agg(F.min_by(F.struct("strategy", "payload"), "priority").alias("w")).select("doc_id", "w.*")
