"""Rows of provider trials as a CSV file, failed runs, matches of many pairs, saves with stamps, and selections."""

from __future__ import annotations

import csv
import glob

import pytest
from pyspark.sql import functions as F

from vatloom.operators import edits, lists, score
from vatloom.sources import files, sinks

FIELDS = "run_id int, field_name string, raw_value string, normalized_value string, confidence double"


@pytest.fixture(scope="module")
def trial(spark):
    runs = spark.createDataFrame(
        [(1, "a,b.pdf", "p", False, 1200.0, None), (2, 'c"d.pdf', "p", True, 9.5, "gave\nup"), (3, None, None, None, 0.125, None)],
        "run_id int, FileName string, ProviderName string, Failed boolean, ProcessingDurationMs double, ErrorMessage string",
    )
    rows = [(1, "InvoiceDate", "05/06/2024", "2024-06-05", 0.9), (1, "TotalAmount", "1.234 VND", " ", 0.5), (1, "DocumentType", "VatInvoice", None, None), (1, "SupplierName", "Công ty  A", None, 0.9), (2, "TotalAmount", "5", "5", 0.1)]
    truth = spark.createDataFrame([("A,B.PDF", "cong ty a", "1234", "9", " "), ('c"d.pdf', "X", "5", None, None)], "FileName string, ExpectedSupplierName string, ExpectedTotalAmount string, ExpectedVatAmount string, ExpectedCurrency string")
    return score.benchmark(runs, spark.createDataFrame(rows, FIELDS), spark.createDataFrame([(1,), (1,), (2,)], "run_id int"), truth)


def test_rows_of_a_trial(trial):
    assert trial.columns[1:] == list(score.COLUMNS) and len(score.COLUMNS) == 45
    a, b, c = trial.orderBy("run_id").collect()
    assert (a["SupplierNameMatched"], a["TotalMatched"], a["VatMatched"], a["InvoiceDateMatched"], a["CurrencyMatched"]) == (True, True, False, None, None)
    assert (a["ExtractedTotalAmount"], a["DocumentCategory"], a["WarningCount"], a["FieldAccuracyPercent"]) == ("1.234 VND", "VatInvoice", 2, 66.67)
    assert a["AverageConfidence"] == pytest.approx((0.9 + 0.5 + 0.9) / 3)
    assert (b["ExpectedTotalAmount"], b["ExtractedTotalAmount"], b["TotalMatched"], b["FieldAccuracyPercent"], b["WarningCount"], b["ProcessingDurationMs"], b["ErrorMessage"]) == ("5", None, None, None, 0, 0.0, "gave\nup")
    assert (c["FileName"], c["PageCount"], c["FieldAccuracyPercent"], c["AverageConfidence"]) == (None, 0, None, None)


def test_trial_as_csv(trial, tmp_path):
    sinks.write_csv(score.benchmark_csv(trial.orderBy("run_id")).coalesce(1), str(tmp_path / "out"))
    with open(glob.glob(f"{tmp_path}/out/part-*")[0], newline="", encoding="utf-8") as f:
        head, *rows = csv.reader(f)
    assert head == list(score.COLUMNS)
    a, b, c = (dict(zip(head, r)) for r in rows)
    assert (a["FileName"], a["ProcessingDurationMs"], a["AverageConfidence"], a["EstimatedCost"], a["FieldAccuracyPercent"], a["SupplierNameMatched"], a["VatMatched"], a["CurrencyMatched"]) == ("a,b.pdf", "1200", "0.7667", "0.000000", "66.67", "True", "False", "")
    assert (b["FileName"], b["ErrorMessage"], b["FieldAccuracyPercent"], b["ExpectedTotalAmount"]) == ('c"d.pdf', "gave\nup", "", "5")
    assert (c["FileName"], c["ProcessingDurationMs"]) == ("", "0.125")


def test_many_pairs_match_as_single_ones(spark):
    values = [None, "", " ", "A-1", "a 1", "1.234", "1234", "05/06/2024", "2024-06-05", "0101234567", "0101234567 ", "VND", "vnd", "đ", "Đ", "x"]
    rows = spark.createDataFrame([(e, a) for e in values for a in values], "e string, a string")
    got = score.matched(rows, {k: (k, "e", "a") for k in ("text", "tax_code", "money", "date", "currency")})
    for r in got.withColumns({f"single_{k}": score.match(k, F.col("e"), F.col("a")) for k in ("text", "tax_code", "money", "date", "currency")}).collect():
        assert all(r[k] == r[f"single_{k}"] for k in ("text", "tax_code", "money", "date", "currency")), r


def test_empty_trial(spark):
    runs = spark.createDataFrame([], "run_id int, FileName string, Failed boolean")
    truth = spark.createDataFrame([], "FileName string")
    assert score.benchmark_csv(score.benchmark(runs, spark.createDataFrame([], FIELDS), runs.select("run_id"), truth)).count() == 0


def test_saves_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, "t0", None), (2, "a", "t0", "t1")], "id int, v string, created_at string, updated_at string")
    sent = spark.createDataFrame([(1, None, "update"), (2, None, "update"), (3, None, "insert"), (4, "x", "update"), (None, "y", "insert")], "id int, v string, change string")
    got = sorted(edits.saved(rows, sent, "id", F.lit("now")).collect(), key=str)
    assert [tuple(r) for r in got] == [(1, None, "t0", None), (2, None, "t0", "now"), (3, None, "now", None), (None, "y", "now", None)]


def test_requests(spark):
    rows = spark.createDataFrame([(1, "Processed"), (2, "Failed"), (3, "Reviewed")], "doc_id long, status string")
    asked = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    lists.require_all(asked, rows)
    with pytest.raises(KeyError, match="Documents not found: 7, 8"):
        lists.require_all(spark.createDataFrame([(8,), (1,), (7,), (8,)], "doc_id long"), rows)
    assert sorted(r[0] for r in lists.exportable(asked, rows).collect()) == [1, 3]


def test_files_worth_sending(spark):
    cases = [("a.pdf", "application/pdf", 20 << 20, True), ("a.pdf", "application/pdf", (20 << 20) + 1, False), ("a.XML", "", 5 << 20, True), ("a.xml", "text/xml", (5 << 20) + 1, False), ("a.pdf", "", 1, False), ("a.exe", "image/png", 1, True), (None, "image/png", 1, False), ("a.png", None, 1, False), ("a.png", "image/png", None, False)]
    rows = spark.createDataFrame(cases, "name string, type string, size long, want boolean")
    for r in rows.withColumn("got", files.worth_sending(F.col("name"), F.col("type"), F.col("size"))).collect():
        assert r["got"] == r["want"], r
