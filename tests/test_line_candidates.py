"""Line rules over many documents: no exchange or sort gathers lines that lie together, no rule runs that isn't asked for, steps are columns."""

from __future__ import annotations

import re

from conftest import SF_SMALL
from pyspark.sql import functions as F
from test_plain_shortcuts import TEXTS

from vatloom.functions import textnorm as T
from vatloom.operators import extract as X
from vatloom.plans import registry

LINES = (
    ("CÔNG TY TNHH Sen", "Due Date:", "01/02/2024", "PO Number: 7", "Thuế GTGT: 8%", "Ghi chú: a  b", "Người bán: B", "Quầy 3"),
    (" ", "Due Date:", "", "Due Date: 1/2/24", None, "PO Number:", "　", "note\nx - y", "tổng 5"), ("", None), (), ("Cty - A;",), ("x\n\ny", "due date 3.4.2024"), None,
)


def _documents(spark):
    line = "array<struct<page:int,line_no:int,text:string,confidence:double>>"
    return spark.createDataFrame([(i, None if t is None else [(1, n, x, 0.9) for n, x in enumerate(t)]) for i, t in enumerate(LINES)], f"doc_id long, lines {line}")


def _rows(df):
    return sorted(map(str, df.collect()))


def test_candidates_are_found_without_gathering(spark):
    plan = registry.QUERIES["other_line_candidates"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert re.search(rf"hashpartitioning\(doc_id#\d+L?, {wanted}\), REPARTITION_BY_NUM", plan)
    assert "collect_list" not in plan and X.TOP_LINE not in plan and "PHIẾU" not in plan


def test_lines_that_lie_together_give_what_gathered_ones_give(spark):
    docs = _documents(spark)
    each = docs.select("doc_id", F.inline("lines")).select("doc_id", "page", "line_no", "text", "confidence")
    together, gathered = X.line_context(None, X.documents(docs)), X.line_context(each)
    assert _rows(together) == _rows(gathered) and together.count() == 16
    got = {(r["doc_id"], r["position"]): (r["text"], r["next_text"], r["n_lines"]) for r in together.collect()}
    assert got[1, 0] == ("Due Date:", "Due Date: 1/2/24", 5) and got[1, 4] == ("tổng 5", None, 5) and not [k for k in got if k[0] in (2, 3, 6)]
    whole = X.numbered_lines(X.documents(docs)).where("position < 0")
    assert {r["doc_id"]: r["text"] for r in whole.collect()} == {i: "\n".join(x for x in t if x is not None) for i, t in enumerate(LINES) if t is not None}
    assert _rows(X.numbered_lines(X.documents(docs)).where("position >= 0")) == _rows(together)


def test_top_lines_alone_are_left_out(spark):
    context = X.line_context(None, X.documents(_documents(spark)))
    every, keywords = X.from_lines(context), X.from_lines(context, top_lines=False)
    assert every.where(F.col("method") == X.TOP_LINE).count() > 0
    assert _rows(every.where(F.col("method") != X.TOP_LINE)) == _rows(keywords)
    found = {(r["doc_id"], r["field_name"], r["raw_value"]) for r in keywords.collect()}
    assert found >= {(0, "SupplierName", "CÔNG TY TNHH Sen"), (0, "DueDate", "01/02/2024"), (0, "PONumber", "7"), (0, "Notes", "a b"), (0, "SupplierName", "B"), (1, "DueDate", "1/2/24"), (1, "PONumber", "note x - y"), (1, "Notes", "y"), (4, "SupplierName", "Cty - A")}


def test_steps_as_columns_give_the_functions(spark):
    df = spark.createDataFrame([(t,) for t in (*TEXTS, *[x for t in LINES if t for x in t], "İI_ß", "Ω é", " : a -;b;- ")], "text string")
    for row in T.with_clean_values(T.with_search_text(df), {"clean": F.col("text")}).select("*", T.search_text(F.col("text")).alias("a"), T.clean_value(F.col("text")).alias("b")).collect():
        assert row["search"] == row["a"] and row["clean"] == row["b"], row


def test_rules_on_documents_run_in_tasks_that_are_not_merged(spark):
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("line_fields", "line_types"):
        plan = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(doc_id#\d+L?, {wanted}\), REPARTITION_BY_NUM", plan), name
