"""Sources on written files, sinks read back, streams on files, and operators that no query runs."""

from __future__ import annotations

import json
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vatloom.functions import normalize as N
from vatloom.functions import textnorm as T
from vatloom.operators import clients, edits, extract, gate, ledger, reports, review, score, validate
from vatloom.sources import files, sinks
from vatloom.streaming import streams


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def one(spark, c, **row):
    frame = spark.createDataFrame([row], ", ".join(f"{k} {'string' if isinstance(v, (str, type(None))) else 'double' if isinstance(v, float) else 'int'}" for k, v in row.items()))
    return frame.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1.234.567 VND", "1234567"), ("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("123,45", "12345"), ("  ", None), ("VND", None), ("-5", "5"), ("Tổng 3 mục: 12.000đ", "12000"), (None, None)],
)
def test_money(spark, raw, want):
    assert one(spark, N.plain_decimal(N.money(F.col("v"))), v=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("20-Mar-2008", "2008-03-20"), ("05/06/2024", "2024-06-05"), ("31/02/2024", None), ("ngày 3 tháng 4 năm 2021", "2021-04-03"), ("12.1.2020", "2020-01-12"), ("March 5, 2019", "2019-03-05"), ("1/2/49", "2049-02-01"), ("1/2/50", "1950-02-01"), ("", None), ("?", None)],
)
def test_dates(spark, raw, want):
    assert one(spark, N.date_loose(F.col("v")).cast("string"), v=raw) == want


def test_normalized_value_and_ids(spark):
    rows = [("TotalAmount", "1.000 đ", None), ("InvoiceDate", "1/2/2020", None), ("SupplierTaxCode", "MST 01-2", None), ("Currency", "vnđ", None), ("Notes", " x ", None), ("Notes", "x", "kept")]
    df = spark.createDataFrame(rows, "f string, r string, n string").select(N.normalized_value(F.col("f"), F.col("r"), F.col("n")).alias("v"), T.stable_id(F.col("r")).alias("i"))
    assert [r["v"] for r in df.collect()] == ["1000", "2020-02-01", "012", "VND", "x", "kept"]
    assert all(len(r["i"]) == 32 for r in df.collect())


def test_files(spark, tmp_path):
    (tmp_path / "b.XML").write_text("<HDon/>")
    (tmp_path / "A.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.png").write_bytes(b"nope")
    df = files.files(spark, str(tmp_path))
    assert [r["path"].rsplit("/", 1)[1] for r in df.collect()] == ["A.pdf", "b.XML", "c.png"]
    assert values(df.select(F.regexp_extract("path", "[^/]+$", 0).alias("f"), files.signature_ok(F.col("path"), F.col("content")).alias("ok")), "f", "ok") == [("A.pdf", True), ("b.XML", True), ("c.png", False)]
    assert [r["xml"] for r in files.xml_documents(spark, str(tmp_path)).collect()] == ["<HDon/>"]
    with pytest.raises(ValueError):
        files.files(spark, f"{tmp_path}/../x")
    assert files.loader("XML") is files.xml_documents and files.loader(None) is files.fixture and files.loader("other") is files.fixture
    assert files.fixture(spark, 2).count() == 10


def test_ground_truth_and_pairs(spark, tmp_path):
    (tmp_path / "gt.csv").write_text('FileName,ExpectedTotalAmount,ExpectedSupplierName\na.pdf, 1 ,"A ""x"", B"\nA.PDF,2,\n ,3,z\nb.pdf,,b\n')
    got = files.ground_truth(spark, str(tmp_path / "gt.csv"))
    assert values(got, "FileName", "ExpectedTotalAmount", "ExpectedSupplierName") == [("A.PDF", "2", None), ("b.pdf", None, "b")]
    (tmp_path / "p.csv").write_text("XmlFile,PdfFile\na.xml,a.pdf\nb.xml,\n, c.pdf\n")
    assert values(files.pairs(spark, str(tmp_path / "p.csv")), "XmlFile", "PdfFile") == [("a.xml", "a.pdf")]


def test_ocr_blobs(spark):
    blob = {"AverageConfidence": 0.5, "Pages": [{"PageNumber": 1, "Confidence": None, "Lines": [{"Text": "x", "Confidence": 0.9}, {"Text": "y"}]}], "KeyValuePairs": [{"KeyText": "k", "ValueText": "v", "Confidence": 0.7, "PageNumber": 1}], "Tables": [{"PageNumber": 1, "Cells": [{"RowIndex": 0, "ColumnIndex": 1, "Text": "c", "Kind": "content"}]}]}
    df = files.ocr(spark.createDataFrame([(1, json.dumps(blob)), (2, "broken"), (3, None)], "doc_id long, json string"))
    assert values(files.ocr_lines(df), "doc_id", "line_no", "text", "confidence") == [(1, 1, "x", 0.9), (1, 2, "y", 0.5)]
    assert values(files.ocr_pairs(df), "doc_id", "key", "value") == [(1, "k", "v")]
    assert values(files.ocr_cells(df), "doc_id", "row", "col", "text") == [(1, 0, 1, "c")]


def test_routed(spark):
    layer = spark.createDataFrame([(1, "a" * 100), (2, " short "), (4, "b" * 200)], "doc_id long, text string")
    scan = spark.createDataFrame([(1, "scan1"), (2, "scan2"), (3, "scan3")], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"][:5], r["provider"]) for r in files.routed(layer, scan).collect()}
    assert got == {1: ("aaaaa", "PdfTextLayer"), 2: ("scan2", "Ocr"), 3: ("scan3", "Ocr"), 4: ("bbbbb", "PdfTextLayer")}
    kept = spark.range(1).select(files.known_features(F.array(F.lit("TABLES"), F.lit("x")), ("Tables", "Keys")).alias("k")).first()["k"]
    assert kept == ["TABLES"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b', "2024-05-06"), (2, None, "2023-01-02")], "doc_id long, text string, day string").withColumn("day", F.to_date("day"))
    sinks.write_csv(df, str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, quote='"', escape='"')
    assert values(back, "doc_id", "text") == [("1", 'a "q", b'), ("2", None)]
    sinks.write_json(df, str(tmp_path / "json"))
    assert values(spark.read.json(str(tmp_path / "json")), "doc_id") == [(1,), (2,)]
    sinks.store(df, str(tmp_path / "store"), "day")
    assert (tmp_path / "store" / "year=2024" / "month=05").is_dir()
    assert spark.read.parquet(str(tmp_path / "store")).where("year = 2023").count() == 1
    sinks.write_workbook({"A & B": df}, str(tmp_path / "w.xlsx"))
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
    assert sheet.count("<row>") == 3 and "a &quot;q&quot;, b" in sheet or 'a "q", b' in sheet
    with pytest.raises(ValueError):
        sinks.write_workbook({"x": df}, str(tmp_path / "y.xlsx"), most=1)
    assert [r["doc_id"] for r in sinks.in_request_order(df, [2, 1]).collect()] == [2, 1]


def test_streams(spark, tmp_path):
    """The gate on a stream gives what the batch gate gives, with requests of a key spread over many rows and in any order."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(rng.randrange(3), i, start + timedelta(minutes=rng.randrange(9000)), rng.choice(["TopUp", "Consume", "Consume"]), rng.randrange(9)) for i in range(30_000)]
    schema = "org_id long, seq long, ts timestamp, type string, amount long"
    df = spark.createDataFrame(rows, schema)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streams.gated(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 20)
    stream.writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert values(spark.table("gated"), "org_id", "seq", "accepted", "balance") == values(ledger.gate(df, 20), "org_id", "seq", "accepted", "balance")
    seen = []
    streams.ingest(spark, str(tmp_path / "in"), schema, lambda batch, i: seen.append(batch.count()), str(tmp_path / "cp2")).awaitTermination(120)
    streams.ingest(spark, str(tmp_path / "in"), schema, lambda batch, i: seen.append(batch.count()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sum(seen) == 30_000
    assert streams.first_seen(df.select("org_id", "ts"), ["org_id"]).count() == 3
    once = streams.first_seen(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).select("org_id", "ts"), ["org_id"])
    once.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp3")).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == 3


def test_line_clustering(spark):
    """Words go from top to bottom; one joins the line while it is near the mean height of the line's words."""
    rng = random.Random(6)
    words = [(d, 1, f"w{i}", float(rng.randrange(100)), float(rng.randrange(60)), float(rng.choice([1, 4, 10]))) for d in range(40) for i in range(rng.randint(1, 25))]
    want = set()
    for d in range(40):
        lines: list = []
        for _, _, text, x, y, h in sorted((w for w in words if w[0] == d), key=lambda w: (-w[4], w[3], w[4], w[5], w[2])):
            if lines and abs(y - sum(lines[-1]["ys"]) / len(lines[-1]["ys"])) <= lines[-1]["tol"]:
                lines[-1]["ys"].append(y)
                lines[-1]["words"].append((x, text))
            else:
                lines.append({"ys": [y], "tol": max(0.6 * h, 1.0), "words": [(x, text)]})
        want |= {(d, i, " ".join(t for _, t in sorted(ln["words"]))) for i, ln in enumerate(lines, 1)}
    got = extract.words_to_lines(spark.createDataFrame(words, "doc_id long, page int, text string, x double, y double, height double"))
    assert {(r["doc_id"], r["line_no"], r["text"]) for r in got.collect()} == want


def test_validation_notes(spark):
    docs = spark.createDataFrame([(1, "RestaurantBill", "Unknown"), (2, "VatInvoice", "Sale")], "doc_id long, profile string, direction string")
    assert values(validate.experimental(docs), "doc_id", "code") == [(1, "EXPERIMENTAL_DOCUMENT_CATEGORY")]
    assert values(validate.direction_unknown(docs), "doc_id", "code") == [(1, "DOCUMENT_DIRECTION_UNKNOWN")]
    fields = spark.createDataFrame([(2, "InvoiceDate", "99/99/2024", None, 0.5), (2, "TotalAmount", "x", None, 0.9)], "doc_id long, field_name string, raw_value string, normalized_value string, confidence double")
    got = {r["code"]: r["message"] for r in validate.validate(fields, docs.where("doc_id = 2"), validate.profiles(spark), F.lit("2024-01-01").cast("date")).collect()}
    assert got["INVALID_INVOICE_DATE"] == "InvoiceDate '99/99/2024' must parse to a valid date."
    assert got["INVALID_TOTAL_AMOUNT"] == "TotalAmount 'x' must be a positive number."
    assert got["LOW_CONFIDENCE"] == "Field 'InvoiceDate' has low confidence (50%). Please verify."


def test_review_helpers(spark):
    docs = spark.createDataFrame([(1, "VatInvoice")], "doc_id long, profile string")
    fields = spark.createDataFrame([(1, "SupplierName", "A", None, 0.5), (1, "VatRate", "8 %", None, 0.6), (1, "SubtotalAmount", "100", None, None), (1, "VatAmount", "8", None, 0.9)], "doc_id long, field_name string, raw_value string, normalized_value string, confidence double")
    profile = validate.profiles(spark)
    mapping = review.mapped(fields, docs, profile)
    assert ("Seller Name",) in values(review.labelled(mapping), "label")
    assert review.overall_confidence(mapping).first()["overall_confidence"] == pytest.approx((0.5 + 0.9 + 0.6) / 3)
    warned = spark.createDataFrame([(1, "SupplierName", "X"), (1, "SellerName", "Y"), (1, None, "Z")], "doc_id long, field_name string, code string")
    assert review.field_warnings(mapping, warned, profile.where("profile = 'VatInvoice'")).where("field_key = 'SellerName'").first()["codes"] == ["X", "Y"]
    line = review.ocr_tax_line(fields, N.vat_rate(F.col("raw_rate"))).first()
    assert (line["vat_rate"], int(line["taxable_amount"]), int(line["tax_amount"])) == ("8%", 100, 8)


def test_other_operators(spark):
    current = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    assert values(clients.upsert(current, spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), "id"), "id", "v") == [(1, "a"), (2, "c"), (3, "d")]
    assert values(edits.reprocessed(current.withColumnRenamed("id", "doc_id"), spark.createDataFrame([(1,)], "doc_id long")), "doc_id") == [(2,)]
    led = spark.createDataFrame([(1, "Consume", 0, datetime(2024, 1, 2)), (1, "Consume", 0, datetime(2024, 1, 1)), (1, "Consume", -2, datetime(2024, 1, 2))], "org_id long, type string, amount long, ts timestamp")
    assert values(ledger.free_documents(led, F.lit("2024-01-02").cast("timestamp"), 0), "org_id", "free_today", "over_cap") == [(1, 1, True)]
    claims = spark.createDataFrame([(1, "Notes", "x", "in it", "this is in it"), (1, "Notes", "x", "not", "this is in it"), (1, "Notes", None, None, None)], "doc_id long, field_name string, value string, source_text string, full_text string")
    assert values(gate.rejects(gate.verified(claims)), "doc_id", "rejected") == [(1, 1)]
    total = reports.totals(spark.createDataFrame([], "rate int, subtotal decimal(18,2), vat decimal(18,2), total decimal(18,2)")).collect()
    assert [(r["is_total"], r["n"], int(r["total"])) for r in total] == [(True, 0, 0)]
    files_, providers = spark.createDataFrame([("a.PDF",), ("b.xml",)], "file string"), spark.createDataFrame([("p", False), ("q", True)], "provider string, pdf_only boolean")
    assert values(score.runs(files_, providers), "file", "provider") == [("a.PDF", "p"), ("a.PDF", "q"), ("b.xml", "p")]
    cells = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 1, 0, "b")], "doc_id long, table_idx int, row int, col int, text string")
    patch = spark.createDataFrame([(1, 0, 0, 0, "new", 1), (1, 0, 0, 0, "later", 2), (1, 0, 9, 9, "none", 1)], "doc_id long, table_idx int, row int, col int, text string, seq int")
    assert values(edits.patch_cells(cells, patch), "row", "text") == [(0, "later"), (1, "b")]
