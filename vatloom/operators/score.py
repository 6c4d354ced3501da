"""Scoring against ground truth. A match is null where there is nothing to compare with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import date_loose, money, plain_decimal, tax_code
from ..functions.textnorm import blank, filled, scorer_text, strip

FIELDS = {"SupplierName": "text", "SupplierTaxCode": "tax_code", "BuyerName": "text", "BuyerTaxCode": "tax_code", "InvoiceNumber": "text", "InvoiceDate": "date", "TotalAmount": "money", "Currency": "currency"}


def match(kind: str, expected: Column, actual: Column) -> Column:
    """Whether an extracted value equals the expected one, compared as its kind."""
    same = {
        "text": F.coalesce(scorer_text(expected) == scorer_text(actual), F.lit(False)),
        "tax_code": F.coalesce(tax_code(expected) == tax_code(actual), F.lit(False)),
        "money": F.coalesce(money(expected) == money(actual), F.lit(False)),
        "date": F.coalesce(date_loose(expected) == date_loose(actual), F.lit(False)),
        "currency": F.coalesce(F.lower(strip(expected)) == F.lower(strip(actual)), F.lit(False)),
    }[kind]
    return F.when(~blank(expected), same)


def accuracy(*matches: Column) -> Column:
    """Percent of evaluated matches that hold, two digits half-even; null if none was evaluated."""
    seen, hits = F.lit(0), F.lit(0)
    for m in matches:
        seen = seen + m.isNotNull().cast("int")
        hits = hits + F.coalesce(m, F.lit(False)).cast("int")
    return F.when(seen > 0, F.bround(hits / seen * 100, 2))


def accuracy_by(rows: DataFrame, hit: Column, key: str) -> DataFrame:
    """Rows and percent of hits of each key, two digits half-even."""
    return rows.groupBy(key).agg(F.count("*").alias("n"), F.bround(F.count_if(hit) / F.count("*") * 100, 2).alias("accuracy"))


def summary(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Results (file, provider, a column a field) against truth (file, Expected<field>), by file name without case."""
    t = truth.withColumn("_key", F.lower("file")).drop("file")
    joined = results.withColumn("_key", F.lower("file")).join(t, "_key", "left")
    matches = {f"match_{f}": match(kind, F.col(f"Expected{f}"), F.col(f)) for f, kind in FIELDS.items() if f in results.columns and f"Expected{f}" in truth.columns}
    out = joined.withColumns(matches)
    return out.withColumn("accuracy", accuracy(*[F.col(m) for m in matches])).drop("_key")


def truth_from_fields(fields: DataFrame) -> DataFrame:
    """Ground truth rows from the fields of parsed XML invoices (file, field_name, raw_value)."""
    names = list(FIELDS)
    value = lambda n: F.first(F.when(F.col("field_name") == n, F.col("raw_value")), ignorenulls=True)
    return fields.groupBy("file").agg(*[value(n).alias(f"Expected{n}") for n in names])


def runs(files: DataFrame, providers: DataFrame) -> DataFrame:
    """Every file with every provider that takes it: the text-layer provider takes PDFs only."""
    return files.join(providers, (~F.col("pdf_only")) | F.lower("file").endswith(".pdf"))


# The fields that a provider's row shows, how each is compared, and its column of matches.
COMPARED = {
    "SupplierName": ("text", "SupplierNameMatched"), "SupplierTaxCode": ("tax_code", "TaxCodeMatched"), "InvoiceNumber": ("text", "InvoiceNumberMatched"),
    "InvoiceDate": ("date", "InvoiceDateMatched"), "SubtotalAmount": ("money", "SubtotalMatched"), "VatAmount": ("money", "VatMatched"),
    "TotalAmount": ("money", "TotalMatched"), "Currency": ("currency", "CurrencyMatched"),
}
# What a run brings along, and the order of the summary's 45 columns.
COUNTS = ("PageCount", "FullTextLength", "LineCount", "WordCount", "ParagraphCount", "TableCount", "KeyValuePairCount")
COLUMNS = (
    "FileName", "DocumentCategory", "ProviderName", "ModelId", "Features", "ProcessingDurationMs", *COUNTS, "AverageConfidence", "EstimatedCost", "RejectedFieldCount",
    *[c for f, (_, m) in COMPARED.items() for c in (f"Extracted{f}", f"Expected{f}", m)],
    "FieldAccuracyPercent", "WarningCount", "RawProviderResponsePath", "NormalizedOcrResultPath", "ErrorMessage",
)


def matched(rows: DataFrame, pairs: dict[str, tuple[str, str, str]]) -> DataFrame:
    """``match`` for many pairs (name: kind, expected column, actual column). All values of a kind go through one transform of an
    array, so that a long normalizer stands in the plan once and not twice a pair. Where nothing is expected, nothing is normalized."""
    forms = {"text": scorer_text, "tax_code": tax_code, "money": money, "date": date_loose, "currency": lambda c: F.lower(strip(c))}
    kinds = {k: [(n, e, a) for n, (kind, e, a) in pairs.items() if kind == k] for k in dict.fromkeys(kind for kind, _, _ in pairs.values())}
    out = rows.withColumns({f"_as_{k}": F.transform(F.array(*[F.when(~blank(F.col(e)), F.col(c)) for _, e, a in some for c in (e, a)]), forms[k]) for k, some in kinds.items()})
    same = {n: F.when(~blank(F.col(e)), F.coalesce(F.col(f"_as_{k}")[2 * i] == F.col(f"_as_{k}")[2 * i + 1], F.lit(False))) for k, some in kinds.items() for i, (n, e, _) in enumerate(some)}
    return out.withColumns(same).drop(*[f"_as_{k}" for k in kinds])


def benchmark(runs: DataFrame, fields: DataFrame, warnings: DataFrame, truth: DataFrame) -> DataFrame:
    """One row of 45 typed columns for each run (a file read by a provider).

    ``runs``: run_id, Failed (whether the provider gave up with an error, not an answer), and the columns of the result that no
    other table gives; a column that is missing is null, or 0 for counts and costs. ``fields``: run_id, field_name, raw_value,
    normalized_value, confidence; ``warnings``: run_id; ``truth``: FileName and Expected<field>, one row a file name without case.
    A field shows its normalized value, or the raw one if that is blank. A failed run keeps its names, its error and what was
    expected: all else is blank or 0, and nothing is compared.
    """
    value = F.coalesce(filled(F.col("normalized_value")), F.col("raw_value"))
    shown = {**{f: f"Extracted{f}" for f in COMPARED}, "DocumentType": "DocumentCategory"}
    wide = fields.groupBy("run_id").agg(*[F.max(F.when(F.col("field_name") == f, value)).alias(c) for f, c in shown.items()], F.avg("confidence").alias("AverageConfidence"))
    warned = warnings.groupBy("run_id").agg(F.count("*").alias("WarningCount"))
    zero = {**dict.fromkeys((*COUNTS, "RejectedFieldCount"), "bigint"), "ProcessingDurationMs": "double", "EstimatedCost": "decimal(18,6)"}
    named = {c: "string" for c in ("ProviderName", "ModelId", "Features", "RawProviderResponsePath", "NormalizedOcrResultPath", "ErrorMessage")}
    has = lambda df, c, kind: (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    r = runs.select("run_id", F.coalesce("Failed", F.lit(False)).alias("_failed"), F.col("FileName").cast("string").alias("FileName"), *[has(runs, c, k) for c, k in {**named, **zero}.items()])
    t = truth.select(F.lower("FileName").alias("_key"), *[has(truth, f"Expected{f}", "string") for f in COMPARED])
    joined = r.withColumn("_key", F.lower("FileName")).join(t, "_key", "left").join(wide, "run_id", "left").join(warned, "run_id", "left")
    answered = lambda c: F.when(~F.col("_failed"), c)
    out = joined.withColumns(
        {c: answered(F.col(c)) for c in (*shown.values(), "AverageConfidence", "ModelId", "RawProviderResponsePath", "NormalizedOcrResultPath")}
        | {c: F.coalesce(answered(F.col(c)), F.lit(0).cast(k)) for c, k in {**zero, "WarningCount": "bigint"}.items()}
        | {"Features": F.coalesce(answered(F.col("Features")), F.lit(""))}
    )
    out = matched(out, {m: (kind, f"Expected{f}", f"Extracted{f}") for f, (kind, m) in COMPARED.items()})
    out = out.withColumns({m: answered(F.col(m)) for _, m in COMPARED.values()})
    return out.withColumn("FieldAccuracyPercent", accuracy(*[F.col(m) for _, m in COMPARED.values()])).select("run_id", *COLUMNS)


def benchmark_csv(rows: DataFrame) -> DataFrame:
    """The 45 columns as texts: confidences with four digits, costs with six, percents with two, True and False, blank for null."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    ms = F.col("ProcessingDurationMs")
    special = {"AverageConfidence": fixed("AverageConfidence", 4), "EstimatedCost": F.col("EstimatedCost").cast("decimal(18,6)").cast("string"), "FieldAccuracyPercent": fixed("FieldAccuracyPercent", 2)}
    special["ProcessingDurationMs"] = F.when(ms == F.floor(ms), F.floor(ms).cast("string")).otherwise(plain_decimal(ms.cast("decimal(30,6)")))
    special |= {m: F.initcap(F.col(m).cast("string")) for _, m in COMPARED.values()}
    text = lambda c: F.when(F.col(c).isNotNull(), special.get(c, F.col(c).cast("string")))
    return rows.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in COLUMNS])
