"""Profiles and validation: warnings as rows of (doc_id, field_name, code, severity, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import date_strict, money_signed, plain_decimal, resolved
from ..functions.textnorm import blank, filled
from . import rules as R

# The messages of warnings.
MESSAGES = {
    "REQUIRED_FIELD_MISSING": "Required field '%s' is missing or empty.",
    "INVALID_TAX_CODE_FORMAT": "Tax code '%s' contains non-digit characters after normalization.",
    "INVALID_TAX_CODE_LENGTH": "Tax code '%s' has %d digits; expected 10 or 13 for a Vietnamese tax code.",
    "INVALID_INVOICE_DATE": "InvoiceDate '%s' must parse to a valid date.",
    "INVOICE_DATE_TOO_FAR_IN_FUTURE": "InvoiceDate '%s' is more than 30 days in the future.",
    "INVALID_TOTAL_AMOUNT": "TotalAmount '%s' must be a positive number.",
    "AMOUNT_CONSISTENCY_MISMATCH": "SubtotalAmount (%s) + VatAmount (%s) = %s, but TotalAmount is %s. Difference exceeds the allowed rounding tolerance.",
    "LOW_CONFIDENCE": "Field '%s' has low confidence (%d%%). Please verify.",
    "DOCUMENT_DIRECTION_UNKNOWN": "Could not determine whether this is a purchase or a sale — please select it manually.",
    "EXPERIMENTAL_DOCUMENT_CATEGORY": "This document category has lower extraction reliability (e.g. handwritten or mixed-format bills) — please review every field carefully.",
}

WARNING = ("doc_id", "field_name", "code", "severity", "message")


def profiles(spark: SparkSession) -> DataFrame:
    """The profile table: a few dozen fixed rows."""
    return spark.createDataFrame(R.profile_rows(), R.PROFILE_SCHEMA)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def category(detected: Column, document_type: Column) -> Column:
    """The detected category if it is one (without case), else by the stored document type."""
    names = {k.lower(): k for k in R.CATEGORY_PROFILE}
    return F.coalesce(_lookup(names, F.lower(filled(detected))), _lookup(R.LEGACY_CATEGORY, document_type), F.lit("Unknown"))


def profile_of(cat: Column) -> Column:
    return _lookup(R.CATEGORY_PROFILE, cat)


def persisted_type(detected: Column, default: str = "Unknown") -> Column:
    """The stored type: one of seven names, else the default."""
    names = {x.lower(): x for x in ("Unknown", "Invoice", "VatInvoice", "Receipt", "PosReceipt", "RestaurantBill", "ExpenseDocument")}
    return F.coalesce(_lookup(names, F.lower(detected)), F.lit(default))


def _warn(df: DataFrame, field, code: str, severity, message: Column) -> DataFrame:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select("doc_id", lit(field).alias("field_name"), F.lit(code).alias("code"), lit(severity).alias("severity"), message.alias("message"))


def required(fields: DataFrame, documents: DataFrame, profile: DataFrame) -> DataFrame:
    """Required profile fields (documents: doc_id, profile) that neither key nor alias fills, reported under the alias if there is one."""
    has = fields.where(~blank(resolved(F.col("normalized_value"), F.col("raw_value")))).select("doc_id", "field_name")
    held = has.groupBy("doc_id").agg(F.collect_set("field_name").alias("names"))
    wanted = documents.join(F.broadcast(profile.where("required")), "profile").join(held, "doc_id", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    missing = wanted.where(~F.array_contains(names, F.col("field_key")) & ~F.coalesce(F.array_contains(names, F.col("alias")), F.lit(False)))
    key = F.coalesce("alias", "field_key")
    return _warn(missing, key, "REQUIRED_FIELD_MISSING", F.col("severity"), F.format_string(MESSAGES["REQUIRED_FIELD_MISSING"], key))


def tax_codes(fields: DataFrame) -> DataFrame:
    """Tax codes with other characters than digits, else of another length than 10 or 13."""
    value = resolved(F.col("normalized_value"), F.col("raw_value"))
    codes = fields.where(F.col("field_name") == "SupplierTaxCode").withColumn("v", value).where(~blank(F.col("v")))
    odd = _warn(codes.where(~F.col("v").rlike(r"(?U)^\d+$")), "SupplierTaxCode", "INVALID_TAX_CODE_FORMAT", "Warning", F.format_string(MESSAGES["INVALID_TAX_CODE_FORMAT"], "v"))
    size = codes.where(F.col("v").rlike(r"(?U)^\d+$") & ~F.length("v").isin(10, 13))
    return odd.unionByName(_warn(size, "SupplierTaxCode", "INVALID_TAX_CODE_LENGTH", "Warning", F.format_string(MESSAGES["INVALID_TAX_CODE_LENGTH"], "v", F.length("v"))))


def dates(fields: DataFrame, as_of: Column) -> DataFrame:
    """Invoice dates that can't be read, or lie more than 30 days after ``as_of``."""
    value = resolved(F.col("normalized_value"), F.col("raw_value"))
    found = fields.where(F.col("field_name") == "InvoiceDate").withColumn("v", value).where(~blank(F.col("v"))).withColumn("d", date_strict(F.col("v")))
    bad = _warn(found.where("d IS NULL"), "InvoiceDate", "INVALID_INVOICE_DATE", "Warning", F.format_string(MESSAGES["INVALID_INVOICE_DATE"], "v"))
    late = found.where(F.col("d") > F.date_add(as_of, 30))
    return bad.unionByName(_warn(late, "InvoiceDate", "INVOICE_DATE_TOO_FAR_IN_FUTURE", "Warning", F.format_string(MESSAGES["INVOICE_DATE_TOO_FAR_IN_FUTURE"], "v")))


def _amount(name: str) -> Column:
    one = F.when(F.col("field_name") == name, F.coalesce(money_signed(resolved(F.col("normalized_value"), F.col("raw_value"))), money_signed(F.col("raw_value"))))
    return F.max(one)


def _present(name: str) -> Column:
    return F.max((F.col("field_name") == name) & ~blank(resolved(F.col("normalized_value"), F.col("raw_value"))))


def totals(fields: DataFrame) -> DataFrame:
    """Totals that can't be read or aren't positive, and subtotal + tax that differ from the total by more than max(1, 0.5 %)."""
    sums = fields.groupBy("doc_id").agg(_amount("SubtotalAmount").alias("s"), _amount("VatAmount").alias("v"), _amount("TotalAmount").alias("t"), _present("TotalAmount").alias("there"), F.max(F.when(F.col("field_name") == "TotalAmount", resolved(F.col("normalized_value"), F.col("raw_value")))).alias("said"))
    bad = _warn(sums.where("there AND (t IS NULL OR t <= 0)"), "TotalAmount", "INVALID_TOTAL_AMOUNT", "Error", F.format_string(MESSAGES["INVALID_TOTAL_AMOUNT"], "said"))
    gap = F.abs(F.col("s") + F.col("v") - F.col("t"))
    off = sums.where(gap > F.greatest(F.lit(1).cast("decimal(38,10)"), F.abs("t") * F.lit("0.005").cast("decimal(10,3)")))
    message = F.format_string(MESSAGES["AMOUNT_CONSISTENCY_MISMATCH"], *[plain_decimal(c) for c in (F.col("s"), F.col("v"), F.col("s") + F.col("v"), F.col("t"))])
    return bad.unionByName(_warn(off, "TotalAmount", "AMOUNT_CONSISTENCY_MISMATCH", "Warning", message))


def low_confidence(fields: DataFrame, least: float = 0.75) -> DataFrame:
    low = fields.where(F.col("confidence") < least)
    return _warn(low, F.col("field_name"), "LOW_CONFIDENCE", "Info", F.format_string(MESSAGES["LOW_CONFIDENCE"], "field_name", F.round(F.col("confidence") * 100).cast("int")))


def experimental(documents: DataFrame) -> DataFrame:
    """A note on documents of a profile that is still on trial."""
    return _warn(documents.where(F.col("profile").isin(*R.EXPERIMENTAL)), F.lit(None).cast("string"), "EXPERIMENTAL_DOCUMENT_CATEGORY", "Info", F.lit(MESSAGES["EXPERIMENTAL_DOCUMENT_CATEGORY"]))


def direction_unknown(documents: DataFrame) -> DataFrame:
    return _warn(documents.where("direction = 'Unknown'"), F.lit(None).cast("string"), "DOCUMENT_DIRECTION_UNKNOWN", "Info", F.lit(MESSAGES["DOCUMENT_DIRECTION_UNKNOWN"]))


def with_direction(warnings: DataFrame, documents: DataFrame) -> DataFrame:
    """Warnings after the direction of ``documents`` (doc_id, direction) was told anew: their old note on it goes, and a new one
    comes where it is unknown; other documents keep theirs."""
    stale = documents.select("doc_id").distinct().withColumn("code", F.lit("DOCUMENT_DIRECTION_UNKNOWN"))
    return warnings.join(stale, ["doc_id", "code"], "left_anti").select(*WARNING).unionByName(direction_unknown(documents))


def validate(fields: DataFrame, documents: DataFrame, profile: DataFrame, as_of: Column) -> DataFrame:
    """All warnings of (doc_id, field_name, raw_value, normalized_value, confidence) under each document's profile."""
    out = required(fields, documents, profile)
    for part in (tax_codes(fields), dates(fields, as_of), totals(fields), low_confidence(fields)):
        out = out.unionByName(part)
    return out
