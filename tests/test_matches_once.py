"""Patterns are run once for each text or line that asks for them, whatever a rule does with the match."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from vatloom.functions import textnorm as T
from vatloom.functions.normalize import MONEY
from vatloom.operators import extract as X
from vatloom.operators import rules as R
from vatloom.plans import registry

LINE = "array<struct<page:int,line_no:int,text:string,confidence:double>>"


@pytest.fixture
def whole_plans(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    yield lambda name: registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_each_pattern_is_searched_once(whole_plans):
    plan = whole_plans("line_fields")
    for pattern in (R.TAX_CODE_TEXT, R.NUMBER_TEXT, R.TOTAL_TEXT, R.VAT_TEXT, R.SUBTOTAL_TEXT):
        assert plan.count(f", {pattern}, 0)") == 1 and plan.count(f", {pattern}, 1)") == 1, pattern
    assert plan.count(f", {MONEY}, 0)") == 2  # a line and the line after
    for name in ("fulltext_regex", "paragraph_regex"):
        assert whole_plans(name).count(f", {R.TOTAL_TEXT}, 0)") == 1
    assert whole_plans("line_types").count(f", {R.CURRENCY_MARKER}, 0)") == 1


def test_candidates_are_sorted_with_what_is_asked_for(whole_plans):
    won = next(x for x in whole_plans("line_fields").splitlines() if "max_by" in x)
    assert "raw_value" in won and "source_text" not in won


def test_keywords_that_hold_another_tell_nothing_more(spark):
    texts = ("so hoa don", "hoa don", "", "s o", "thue gtgt", "gtg", "thanh tien chua thue", "notes", "invoice number", "invoice nu", "tong", None)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lists = (R.INVOICE_NUMBER, R.INVOICE_DATE, R.VAT, R.SUBTOTAL, R.NOTES, tuple(R.TOTAL_WEIGHTS), ("a", "a"), ())
    for row in df.select("t", *[T.contains_any(F.col("t"), k).alias(f"k{i}") for i, k in enumerate(lists)]).collect():
        for i, k in enumerate(lists):
            assert row[f"k{i}"] == (None if row["t"] is None and k else any(x in row["t"] for x in k) if k else False), (row, k)
    assert T.contains_any(F.col("t"), ("so", "so hoa don"))._jc.toString().count("contains") == 1


def test_a_match_has_its_hint_but_for_folded_letters(spark):
    """Every character that a pattern takes for one of its letters or blanks is that in search text too, but for those named."""
    labels = "Mã số thuế MST Tax code Số hóa đơn Số HĐ Invoice No Number Tổng thanh toán cộng tiền VAT Thuế GTGT Cộng tiền hàng Subtotal Thành tiền chưa thuế"
    letters = sorted(set(labels.replace(" ", "")))
    every = spark.createDataFrame([(chr(i),) for i in range(1, 0x20000) if not 0xD800 <= i < 0xE000], "c string")
    same = every.where(F.col("c").rlike("(?iuU)^(?:" + "|".join(letters) + r"|\s)$")).select("c", T.search_text(F.col("c")).alias("s"), *[F.col("c").rlike(f"(?iuU)^{x}$").alias(f"m{i}") for i, x in enumerate(letters)], F.col("c").rlike(r"(?U)^\s$").alias("white"))
    plain = {x: spark.range(1).select(T.search_text(F.lit(x))).first()[0] for x in letters}
    odd = {r["c"] for r in same.collect() if (r["white"] and r["s"] != "") or any(r[f"m{i}"] and r["s"] != plain[x] for i, x in enumerate(letters))}
    assert odd == set(X.FOLDED)


def test_texts_without_search_text_give_the_same(spark):
    texts = ("Số hóa đơn: HD-1\nMST: 0101234567", "ſố HĐ: HD-2\nTổng: 5", "ınvoıce no: A12", "ınvoıce no: A12\nso 1", "Subtotal 3\nvat 4", "", None, "1.2.2024")
    docs = X.documents(spark.createDataFrame([(i, [(1, 0, t, 0.9)]) for i, t in enumerate(texts)], f"doc_id long, lines {LINE}"))
    asked = ("InvoiceNumber", "SupplierTaxCode", "TotalAmount", "VatAmount", "SubtotalAmount", "InvoiceDate")
    bare = X._with_matches(X.numbered_lines(docs, hinted=False), F.col("position") < 0).where("position < 0")
    full = X._with_matches(X.numbered_lines(docs), F.col("position") < 0).where("position < 0")
    names = [f"match_{i}" for i in range(len(X._TEXT_RULES))]
    given = lambda rows: {r["doc_id"]: [r[n] or "" for n in names] for r in rows.collect()}
    assert given(bare) == given(full) and given(bare)[2][1] == "" and given(bare)[3][1] != "" and given(bare)[0][1] == "Số hóa đơn: HD-1"
    assert {r["doc_id"]: r["search"] is None for r in bare.collect()} == {0: True, 1: False, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True}
    assert X.extract(None, docs=docs, only=asked).where("field_name = 'InvoiceNumber' AND doc_id = 0").first()["raw_value"] == "HD-1"


def test_the_line_after_is_searched_where_the_line_has_no_match(spark):
    lines = ("Mã số thuế:", "0101234567-001", "Số hóa đơn: ", "HD-77", "Ngày hóa đơn", "1/2/2024", "Tổng cộng:", "1.234 đ", "Tổng cộng: 5", "6", "MST", None, "Thuế GTGT", "KCT")
    docs = spark.createDataFrame([(1, [(1, n, x, 0.9) for n, x in enumerate(lines)]), (2, [(1, 0, "Số hóa đơn", None)]), (3, None)], f"doc_id long, lines {LINE}")
    got = {(r["position"], r["field_name"]): (r["raw_value"].strip(), r["source_text"]) for r in X.from_lines(X.line_context(None, X.documents(docs))).where("method = 'LineKeyword'").collect()}
    assert got[0, "SupplierTaxCode"] == ("0101234567-001", lines[0]) and got[2, "InvoiceNumber"] == ("HD-77", lines[2])
    assert got[4, "InvoiceDate"] == ("1/2/2024", lines[4]) and got[6, "TotalAmount"] == ("1.234 đ", "1.234 đ") and got[8, "TotalAmount"] == ("5", "Tổng cộng: 5")
    assert not [k for k in got if k[1] == "VatRate"] and not [k for k in got if k[0] == 10]
