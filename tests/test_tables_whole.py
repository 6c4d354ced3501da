"""Tables are read whole: cells are neither sorted nor joined again, and odd cells give what grouping them row by row gave."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from vatloom.functions import textnorm as T
from vatloom.operators import extract as X
from vatloom.operators import review as V
from vatloom.plans import registry

CELL = "doc_id long, table_idx int, page int, row int, col int, text string, kind string"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["table_footer", "line_items_sheet"])
def test_one_exchange_and_no_join(spark, name):
    text = plan(registry.QUERIES[name](spark, SF_SMALL))
    assert text.count("Exchange ") == 1
    assert "Join" not in text and "Window" not in text and "Union" not in text


def test_footers_of_odd_tables(spark):
    rows = [
        (1, 0, 1, 0, 0, "x", None), (1, 0, 1, 0, 1, "1.000", None), (1, 0, 1, 4, 0, "Tổng cộng", None), (1, 0, 1, 4, 1, "5.000", None), (1, 0, 1, 4, 2, "7.000", None), (1, 0, 1, 4, 2, "6.000", None),
        (1, 1, 2, 3, 2, "VAT 10", None), (1, 1, 2, 3, 2, "9", None), (1, 1, 2, 5, None, "Tổng 3", None), (1, 1, 2, 6, 0, None, None),
        (2, 0, 1, 1, 1, "tong", None), (2, 0, 1, 1, 0, "total 8", None),
    ]
    found = X.from_table_footers(spark.createDataFrame(rows, CELL))
    got = sorted((r["doc_id"], r["position"], r["field_name"], r["raw_value"], round(r["confidence"], 4), r["source_text"]) for r in found.collect())
    assert [(d, p, f, v.strip(), c, s) for d, p, f, v, c, s in got] == [
        (1, 4, "TotalAmount", "7.000", 0.9, "Tổng cộng | 7.000"), (1, 100003, "VatAmount", "10", 0.835, "VAT 10 | VAT 10"), (2, 1, "TotalAmount", "8", 0.8, "total 8 | total 8"),
    ]


def test_items_of_odd_tables(spark):
    head, rows = "columnHeader", [(1, 0, 1, 2, 0, "Ten hang", "columnHeader"), (1, 0, 1, 2, 1, "SL", "columnHeader"), (1, 0, 1, 2, 3, "SL", "columnHeader")]
    rows += [(1, 0, 1, 0, 0, "before", None), (1, 0, 1, 0, 1, "3", head), (1, 0, 1, 5, 0, "a", None), (1, 0, 1, 5, 0, "b", None), (1, 0, 1, 5, 1, "x", None), (1, 0, 1, 6, 0, " ", None), (1, 0, 1, 7, 0, "Tổng", None), (1, 0, 1, None, 0, "c", None)]
    rows += [(2, 0, 1, 0, 0, "Ten", None), (2, 0, 1, 1, 0, "no number column", None)]
    got = sorted((r["doc_id"], r["row"], r["description"], r["quantity"], r["confidence"]) for r in V.line_items(spark.createDataFrame(rows, CELL)).collect())
    assert [(d, r, t, None if q is None else float(q), c) for d, r, t, q, c in got] == [(1, 0, "before", 3.0, 0.75), (1, 5, "b", None, 0.4)]


def test_search_text_of_any_script(spark):
    text = ["  Tổng  \tCỘNG  ", "Áb \n", "ΑΒΓ Đ_đ", "PLAIN a  b", "", "　", "İ \x0b x", None]
    want = ["tong cong", "ab", "αβγ d_d", "plain a b", "", "", "i x", None]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    assert [r[0] for r in df.select(T.search_text(df.t)).collect()] == want
    assert [r[0] for r in df.select(T.strip(df.t)).collect()] == ["Tổng  \tCỘNG", "Áb", "ΑΒΓ Đ_đ", "PLAIN a  b", "", "", "İ \x0b x", None]
    assert [r[0] for r in df.select(T.blank(df.t)).collect()] == [False, False, False, False, True, True, False, True]
