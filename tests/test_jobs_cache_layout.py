"""The job queue over restarts, the response cache over runs, sources by name, XML in odd places, layout answers, direction notes."""

from __future__ import annotations

import os
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vatloom.operators import clients, extract, lists, reports, review, validate, xmlinvoice
from vatloom.sources import cache, files, layout, named, sinks
from vatloom.streaming import jobs


def values(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_a_job_that_fails_twice_succeeds_after_a_restart(spark, tmp_path):
    """Document 1 fails twice, 2 succeeds at once, 3 fails for good; the stream stops between attempts and starts again."""
    schema, seen = "doc_id long, payload string", str(tmp_path / "seen")
    os.makedirs(seen)
    spark.createDataFrame([(1, "flaky"), (2, "fine"), (3, "broken"), (1, "flaky")], schema).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def work(doc_id: int, payload: str, attempt: int) -> None:
        open(f"{seen}/{doc_id}-{attempt}", "a").close()
        if payload == "broken" or payload == "flaky" and attempt < 3:
            raise ValueError(f"{payload} {attempt}")

    def start():
        attempts = jobs.processed(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), work, delays=(2, 2, 2))
        return attempts.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def until(name: str, most: float = 90) -> None:
        end = time.time() + most
        while not os.path.exists(f"{seen}/{name}") and time.time() < end:
            time.sleep(0.1)
        assert os.path.exists(f"{seen}/{name}")

    try:
        query = start()
        until("1-1")
        until("3-1")
        deadline = time.time() + 60
        while not query.recentProgress and time.time() < deadline:
            time.sleep(0.1)
        query.stop()
        query = start()
        until("3-4")
        until("1-3")
        time.sleep(3)
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.schema(jobs.OUT).parquet(str(tmp_path / "out"))
    assert values(got, "doc_id", "attempt", "outcome") == [
        (1, 1, "retry"), (1, 2, "retry"), (1, 3, "succeeded"), (2, 1, "succeeded"), (3, 1, "retry"), (3, 2, "retry"), (3, 3, "retry"), (3, 4, "failed"),
    ]
    assert jobs.DELAYS == (30, 120, 300)


def entry(h, model, text, second):
    return (h, model, text, datetime(2024, 1, 1, 0, 0, second))


def test_cache_keeps_the_newest_over_runs(spark, tmp_path):
    path, schema = str(tmp_path / "cache"), "text_hash string, model string, response_json string, created_at timestamp"
    first = spark.createDataFrame([entry("a", "m", "old", 1), entry("b", "m", "b1", 1), entry("a", "n", "other model", 1), entry("a", "m", "newer", 2)], schema)
    cache.remember(first, path, buckets=4)
    untouched = {f: os.path.getmtime(f"{path}/{d}/{f}") for d in os.listdir(path) if d.startswith("bucket") for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")}
    second = spark.createDataFrame([entry("a", "m", "newest", 3), entry("b", "m", "late but old", 0)], schema)
    cache.remember(second.where("text_hash = 'a'"), path, buckets=4)
    left = {f for d in os.listdir(path) if d.startswith("bucket") for f in os.listdir(f"{path}/{d}")}
    assert len([f for f in untouched if f in left]) >= 1, "buckets without new keys aren't written again"
    for _ in range(2):  # the same again changes nothing
        cache.remember(second, path, buckets=4)
    assert values(cache.read(spark, path), "text_hash", "model", "response_json") == [("a", "m", "newest"), ("a", "n", "other model"), ("b", "m", "b1")]
    cache.remember(second.limit(0), path)
    docs = spark.createDataFrame([(1, "  x \n y "), (2, "x y"), (3, None), (4, "z" * 30_000)], "doc_id long, text string")
    asked = cache.asked(docs, "m")
    known = asked.where("doc_id = 1").select("text_hash", "model", F.lit("r").alias("response_json"), F.lit(datetime(2024, 1, 1)).alias("created_at"))
    cache.remember(known, path, buckets=4)
    got = {r.doc_id: (r.hit, r.response_json, r.given) for r in cache.looked_up(asked, cache.read(spark, path)).collect()}
    assert got[1][:2] == got[2][:2] == (True, "r") and got[3][0] is False and got[4][0] is False and len(got[4][2]) == 20_000


def test_cache_by_stream_restarts(spark, tmp_path):
    schema, path = "text_hash string, model string, response_json string, created_at timestamp", str(tmp_path / "cache")
    for run in (1, 2):
        spark.createDataFrame([entry("k", "m", f"r{run}", run), entry(f"only{run}", "m", "x", run)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        cache.remember_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), path, str(tmp_path / "cp")).awaitTermination(120)
    assert values(cache.read(spark, path), "text_hash", "response_json") == [("k", "r2"), ("only1", "x"), ("only2", "x")]


def test_sources_by_name(spark):
    named.register(spark)
    df = spark.read.format("fixture").option("count", 7).option("partitions", 3).load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 35 and values(df.where("line_no = 3 AND doc_id = 6"), "text") == [("Số HĐ: B-001",)]
    assert named.lines_of(spark, "FIXTURE", count=2).count() == 10 and named.lines_of(spark, None).count() == 5 and named.lines_of(spark, "no such", count=0).count() == 0
    assert files.fixture(spark, 2, 2).count() == 10
    won = {r.field_name: r.raw_value for r in extract.extract(df.where("doc_id = 0")).collect()}
    assert won["InvoiceNumber"] == "B-001" and won["DocumentType"] == "PosReceipt"


BODY = '<TTChung><SHDon>7</SHDon></TTChung><NDHDon><NBan><Ten>A</Ten></NBan><NMua><Ten>B</Ten></NMua><TToan><THTTLTSuat><LTSuat><TSuat>8%</TSuat><ThTien>100</ThTien></LTSuat><LTSuat><ThTien>1</ThTien></LTSuat></THTTLTSuat><TgTTTBSo>108</TgTTTBSo></TToan></NDHDon>'
ODD = {
    "below the root": f'<HDon><DLHDon Id="L1">{BODY}</DLHDon></HDon>',
    "root itself": f'<DLHDon Id="L1">{BODY}</DLHDon>',
    "in an envelope": f'<TDiep><DLieu><HDon><DLHDon Id="L1">{BODY}</DLHDon></HDon></DLieu></TDiep>',
    "prefixes": f'<a:HDon xmlns:a="urn:a"><a:DLHDon Id="L1">{BODY.replace("<T", "<a:T").replace("</T", "</a:T").replace("<N", "<a:N").replace("</N", "</a:N")}</a:DLHDon></a:HDon>',
    "decoy first": f'<HDon><Signature><DLHDon Id="X"><TTChung><SHDon>0</SHDon></TTChung></DLHDon></Signature><DLHDon Id="L1">{BODY}</DLHDon></HDon>',
    "two invoices": f'<HDon><DLHDon Id="L1">{BODY}</DLHDon><DLHDon Id="L2"><TTChung><SHDon>9</SHDon></TTChung></DLHDon></HDon>',
    "blocks elsewhere": f'<HDon><DLHDon Id="L1">{BODY.replace("<NDHDon>", "").replace("</NDHDon>", "")}</DLHDon></HDon>',
    "repeated tags": f'<HDon><DLHDon Id="L1">{BODY.replace("<SHDon>7</SHDon>", "<SHDon>7</SHDon><SHDon>8</SHDon>")}</DLHDon></HDon>',
}


def test_xml_in_odd_places(spark):
    """Wherever the invoice stands, the same fields and lines come out; bad documents give none."""
    bad = {"cut off": "<HDon><DLHDon>", "doctype": "<!DOCTYPE x []>" + ODD["root itself"], "none": "<HDon/>", "null": None, "blank": "  ", "only decoy": "<HDon><Signature><DLHDon/></Signature></HDon>", "no xml": "x"}
    df = spark.createDataFrame([*ODD.items(), *bad.items()], "doc_id string, xml string")
    status = dict(values(xmlinvoice.readable(df), "doc_id", "xml_status"))
    assert {status[k] for k in ODD} == {"ok"} and status["none"] == status["only decoy"] == "no invoice"
    assert {status[k] for k in ("cut off", "doctype", "null", "blank", "no xml")} == {"unreadable"}
    got = {}
    for r in xmlinvoice.fields(df).collect():
        got.setdefault(r.doc_id, {})[r.field_name] = r.raw_value or r.normalized_value
    wanted = {"InvoiceNumber": "7", "SupplierName": "A", "BuyerName": "B", "TotalAmount": "108", "Currency": "VND", "DocumentType": "VatInvoice", "LookupCode": "L1", "InvoiceNature": "Hóa đơn gốc"}
    assert got == {k: wanted for k in ODD}
    lines = {}
    for r in xmlinvoice.tax_lines(df).collect():
        lines.setdefault(r.doc_id, []).append((r.sort_order, r.raw_rate, int(r.taxable_amount)))
    assert {k: sorted(v, key=str) for k, v in lines.items() if k != "blocks elsewhere"} == {k: [(0, "8%", 100), (1, None, 1)] for k in ODD if k not in ("blocks elsewhere", "root itself", "in an envelope")} | {k: lines[k] for k in ("root itself", "in an envelope")}
    assert all(lines[k][0] == (0, "8%", 100) for k in ODD)


def test_full_text_stands_in_for_lines(spark):
    lines = spark.createDataFrame([(1, 1, 1, "MST: 0101234567", 0.9), (2, 1, 1, "  ", 0.9)], "doc_id long, page int, line_no int, text string, confidence double")
    texts = spark.createDataFrame([(2, "Đơn vị bán hàng: Cong ty A\n\nMã số thuế: 0309999999", 0.5), (3, "Đơn vị bán hàng: Cong ty B", None)], "doc_id long, text string, confidence double")
    won = extract.extract(lines, texts=texts)
    names = values(won.where("field_name = 'SupplierName'"), "doc_id", "raw_value", "method", "page")
    assert names == [(2, "Cong ty A", "LineKeyword", 1), (3, "Cong ty B", "LineKeyword", 1)]
    assert values(won.where("field_name = 'SupplierTaxCode'"), "doc_id", "raw_value") == [(1, "0101234567"), (2, "0309999999")]
    only = extract.extract(lines, texts=texts, only=("SupplierTaxCode",))
    assert values(only, "doc_id", "field_name", "raw_value") == [(1, "SupplierTaxCode", "0101234567"), (2, "SupplierTaxCode", "0309999999")]


def test_layout_answers(spark):
    poly = [0, 0, 9, 0, 9, 8, 0, 8]
    import json

    answer = {"pages": [{"pageNumber": 2, "lines": [{"content": "a b", "polygon": poly}, {"content": "far", "polygon": [0]}], "words": [{"content": "a", "confidence": 0.5, "polygon": [1, 2, 3, 4, 5], "span": {"offset": 3, "length": 1}}, {"content": "b", "polygon": [0, 99]}, {"content": "c"}]}, {"pageNumber": 3}], "tables": [{"rowCount": 1, "columnCount": 1, "cells": [{"rowIndex": 0, "columnIndex": 0, "content": "x"}]}], "keyValuePairs": [{"key": {"content": "k"}}]}
    df = layout.decoded(spark.createDataFrame([(1, json.dumps(answer)), (2, "{"), (3, None)], "doc_id long, json string"))
    ln = {r.line_no: r for r in layout.lines(df).collect()}
    assert [w.text for w in ln[1].words] == ["a"] and [(p.x, p.y) for p in ln[1].words[0].points] == [(1, 2), (3, 4)] and ln[1].words[0].span_offset == 3
    assert ln[2].words == [] and ln[2].points is None and len(ln) == 2
    assert values(layout.pages(df), "page", "width", "full_text") == [(2, 0.0, "a b far"), (3, 0.0, "")]
    assert values(layout.words(df), "word_no", "text") == [(1, "a"), (2, "b"), (3, "c")]
    assert values(layout.cells(df), "row_span", "col_span", "text", "page") == [(1, 1, "x", None)]
    assert values(layout.pairs(df), "key", "value") == [("k", None)] and layout.paragraphs(df).count() == 0


def test_direction_notes_and_summaries(spark):
    docs = spark.createDataFrame([(1, "Unknown"), (2, "Sale")], "doc_id long, direction string")
    old = spark.createDataFrame([(2, None, "DOCUMENT_DIRECTION_UNKNOWN", "Info", "x"), (2, "f", "LOW_CONFIDENCE", "Info", "y"), (3, None, "DOCUMENT_DIRECTION_UNKNOWN", "Info", "z")], "doc_id long, field_name string, code string, severity string, message string")
    for _ in range(2):  # replaced on each run, not added
        old = validate.with_direction(old, docs)
    assert values(old, "doc_id", "code") == [(1, "DOCUMENT_DIRECTION_UNKNOWN"), (2, "LOW_CONFIDENCE"), (3, "DOCUMENT_DIRECTION_UNKNOWN")]
    assert old.where("doc_id = 1").first().message == "Could not determine whether this is a purchase or a sale — please select it manually."
    none = spark.createDataFrame([], "doc_id long, table_idx int")
    got = lists.debug_summary(spark.createDataFrame([(1, 2), (2, None)], "doc_id long, page_count int"), spark.createDataFrame([(1, 0), (1, 0), (1, 1)], "doc_id long, table_idx int"), none, none)
    assert values(got, "summary") == [("0 page(s), 0 table(s), 0 field(s), 0 warning(s)",), ("2 page(s), 2 table(s), 0 field(s), 0 warning(s)",)]


@pytest.mark.parametrize(("request_", "wanted"), [((1, "T", None), True), ((1, "T", 5), False), ((1, "T", 6), True), ((2, "T", None), False), ((1, None, None), False), ((1, "D", 8), True)])
def test_tax_code_taken(spark, request_, wanted):
    held = spark.createDataFrame([(5, 1, "T"), (7, 1, None), (8, 1, "D"), (9, 1, "D")], "client_id long, org_id long, tax_code string")
    asked = spark.createDataFrame([(0, *request_)], "request_id long, org_id long, tax_code string, client_id long")
    assert clients.taken(asked, held).first().taken is wanted


def test_names_and_width(spark):
    df = spark.createDataFrame([("Đông",), ("anh",), ("Ánh",), ("dung",), ("ÊM",), ("E",)], "name string")
    assert [r.name for r in lists.by_name(df, "name").collect()] == ["anh", "Ánh", "Đông", "dung", "E", "ÊM"]
    cells = spark.createDataFrame([(1, 0, 0, 0, "a"), (1, 0, 0, 3, "b"), (1, 0, 0, 3, "z")], "doc_id long, table_idx int, row int, col int, text string")
    assert review.table_sheet(cells).collect()[0][3:] == ("a", "", "", "b") and review.table_width(cells.limit(0)) == 0
    assert review.table_sheet(cells.limit(0)).collect() == []


def test_a_report_as_a_workbook_of_three_sheets(spark, tmp_path):
    """Rows in order over many part files, sums after their rates, skipped documents with reasons; read back as any reader would."""
    import xml.etree.ElementTree as ET
    import zipfile

    docs = spark.createDataFrame([(i, 1, 1, "Processed", f"F{i:03}.pdf", datetime(2024, 1, 1 + i % 28), datetime(2024, 2, 1)) for i in range(200)] + [(900, 1, 2, "Processed", "other.pdf", datetime(2024, 1, 1), datetime(2024, 1, 1)), (901, 1, 1, "Failed", "failed.pdf", datetime(2024, 1, 1), datetime(2024, 1, 1))], "doc_id long, org_id int, client_id int, status string, file_name string, created_at timestamp, updated_at timestamp").repartition(7)
    rows = []
    for i in range(200):
        if i % 50:
            rows.append((i, "InvoiceDate", f"2024-01-{1 + i % 28:02}"))
        rows += [(i, "TotalAmount", str(1000 + (80 if i % 2 else 100))), (i, "SubtotalAmount", "1000"), (i, "VatAmount", "80" if i % 2 else "100"), (i, "SupplierName", 'A & <B> "C"'), (i, "InvoiceNumber", f"N{i:03}")]
    fields = spark.createDataFrame([(d, n, v, v, 0.9) for d, n, v in rows], "doc_id long, field_name string, raw_value string, normalized_value string, confidence double")
    period = F.lit("2024-01-01").cast("date"), F.lit("2024-01-31").cast("date")
    body, skipped = reports.report(docs, fields, 1, 1, *period)
    summary = sinks.documents_sheet(docs, reports.pivoted(fields)).drop("doc_id")
    path = f"{tmp_path}/deep/report.xlsx"
    sinks.write_workbook({"BangKeMuaVao": body, "CanhBao": skipped, "Documents": summary}, path, order={"BangKeMuaVao": "line", "CanhBao": "line", "Documents": "file_name"})
    assert os.listdir(f"{tmp_path}/deep") in (["report.xlsx", ".report.xlsx.crc"], [".report.xlsx.crc", "report.xlsx"], ["report.xlsx"])

    def sheet(z, i):
        ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
        return [["".join(c.itertext()) for c in row] for row in ET.fromstring(z.read(f"xl/worksheets/sheet{i}.xml")).iter(f"{ns}row")]

    with zipfile.ZipFile(path) as z:
        names = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).iter("{http://schemas.openxmlformats.org/spreadsheetml/2006/main}sheet")]
        listed, left, summed = (sheet(z, i) for i in (1, 2, 3))
    assert names == ["BangKeMuaVao", "CanhBao", "Documents"]
    numbers = [r[0] for r in listed[1:]]
    assert [int(n) for n in numbers if n] == list(range(1, 197)) and [r[-1] for r in listed[1:] if r[-1]] == ["Cộng 8%:", "Cộng 10%:", "TỔNG CỘNG"]
    assert listed[1][3] == 'A & <B> "C"' and listed[101][-1] == "Cộng 8%:" and float(listed[101][5]) == 100_000 and float(listed[-1][5]) == 196_000
    assert [r[0] for r in left[1:]] == ["F000.pdf", "F050.pdf", "F100.pdf", "F150.pdf"] or {r[0] for r in left[1:]} == {"F000.pdf", "F050.pdf", "F100.pdf", "F150.pdf"}
    assert {r[1] for r in left[1:]} == {"Thiếu hoặc không đọc được ngày hóa đơn."} and len(summed) == 203
    ledger, _ = reports.report(docs, fields, 1, 1, *period, reports.REVENUE)
    kept = ledger.orderBy("line").collect()
    assert kept[-1].label == "Cộng phát sinh:" and len(kept) == 197 and kept[0].booking_date == "2024-02-01" and kept[0].vat_rate is None
    none, _ = reports.report(docs, fields, 1, 77, *period)
    assert [(r.label, int(r.total)) for r in none.collect()] == [("TỔNG CỘNG", 0)]
