"""What is asked of a layout answer as a whole: one rendering, one decoding, and what the join of its parts gives."""

from __future__ import annotations

import json

from conftest import SF_SMALL, same_rows
from pyspark.sql import functions as F

from vatloom.plans import queries, registry
from vatloom.sources import layout as Y

BOX = [0.0, 1.0, 9.0, 1.0, 9.0, 3.0, 0.0, 3.0]


def _page(number, lines, words):
    return {"pageNumber": number, "lines": lines and [{"content": x, "polygon": BOX, "spans": []} for x in lines], "words": words and [{"content": x, "confidence": 0.5, "polygon": BOX} for x in words]}


def _part(text, page=1):
    return {"content": text, "boundingRegions": [{"pageNumber": page, "polygon": BOX}]}


WHOLE = {
    "pages": [_page(1, ["a", None, "b"], ["x", "y"]), _page(2, None, None), None, _page(3, ["c"], ["z"])],
    "tables": [{"rowCount": 1, "cells": [{"rowIndex": 0, "content": "q"}]}],
    "paragraphs": [_part("T") | {"role": "title"}, _part("U"), _part("V", 2), {"content": "W"}, None],
    "keyValuePairs": [{"key": _part("No"), "value": _part("7")}, {"key": _part("No"), "value": None}, {"key": _part("On"), "value": _part("8")}, {"key": None}],
}
PARTS = ("pages", "paragraphs", "keyValuePairs")
LAST = {k: WHOLE[k] for k in (*PARTS, "tables")}
BLOBS = [
    json.dumps(WHOLE), json.dumps({}), "null", "7", "", None, "{", json.dumps(WHOLE | {"pages": [_page(1, ["a"], [])]}), json.dumps(WHOLE | {"pages": [_page(1, [], ["w"])]}),
    *[json.dumps({k: v for k, v in WHOLE.items() if k != left}) for left in PARTS], *[json.dumps(WHOLE | {k: []}) for k in PARTS], *[json.dumps(WHOLE | {k: "none"}) for k in WHOLE],
    *[json.dumps(x)[:n] for x in (WHOLE, LAST) for n in range(1, len(json.dumps(x)), 97)], *[json.dumps(LAST)[:-n] for n in range(1, 90)],
]


def test_documents_give_what_the_join_of_parts_gives(spark):
    df = spark.createDataFrame(list(enumerate(BLOBS)), "doc_id long, json string")
    one = Y.documents(Y.decoded(df, kind=Y.DOCUMENT), lambda g: g["page"] == 1, lambda k: k["key"] == "No")
    one = one.select("doc_id", F.col("paragraph.text").alias("paragraph"), "paragraph.role", "pair.value", "words", "page", "full_text")
    a = Y.decoded(df)
    g = Y.paragraphs(a).where("page = 1").select("doc_id", F.col("text").alias("paragraph"), "role")
    joined = g.join(Y.pairs(a).where("key = 'No'").select("doc_id", "value"), "doc_id").join(Y.words(a).groupBy("doc_id").agg(F.count("*").alias("words")), "doc_id").join(Y.pages(a).select("doc_id", "page", "full_text"), "doc_id")
    got, wanted = (sorted(map(str, x.collect())) for x in (one, joined.select(*one.columns)))
    assert got == wanted
    first = one.where("doc_id = 0").collect()
    assert len(first) == 16 and {(r["page"], r["full_text"], r["words"]) for r in first} == {(1, "a b", 3), (2, "", 3), (None, "", 3), (3, "c", 3)}


def test_layout_documents_decode_once(spark):
    made = registry.QUERIES["layout_documents"](spark, SF_SMALL)._jdf.queryExecution()
    assert made.optimizedPlan().toString().count("from_json(") == 1 and "Join" not in made.executedPlan().toString()


def test_rendered_answers_are_read_whole(spark, duck, tmp_path):
    """Odd items: without a part or quantity, alike, many; the answers' members are those of the items."""
    rows = [(1, None, 5, 1, 3.0, 1.0, 0.0, 0.0), (1, 7, 5, 2, None, 1.0, 0.0, 0.0), (2, 8, 5, 1, 1.0, 1.0, 0.0, 0.0), (2, 8, 5, 1, 1.0, 1.0, 0.0, 0.0), (11, 8, 5, 1, 1.0, 1.0, 0.0, 0.0), (0, 3, 5, 1, 1.0, 1.0, 0.0, 0.0), *[(3, i, 5, 1, 100.0 / 3, 1.0, 0.0, 0.0) for i in range(1, 1201)]]
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    types = ("long", "long", "long", "int", "double", "double", "double", "double")
    spark.createDataFrame(rows, ", ".join(map(" ".join, zip(names, types)))).write.parquet(f"{tmp_path}/lineitem.parquet")
    made = {r["doc_id"]: r["json"] for r in queries._answers(spark, str(tmp_path)).collect()}
    one, three = json.loads(made[1]), json.loads(made[3])
    assert one["pages"][0]["lines"][0] == {"polygon": [0.0, 10.0, 9.0, 10.0, 9.0, 18.0, 0.0, 18.0], "spans": [{"offset": 100, "length": 3}]}
    assert one["pages"][0]["words"][3] == {"content": "7", "polygon": [0.0, 23.0, 9.0, 23.0, 9.0, 25.0, 0.0, 25.0], "span": {"offset": 200, "length": 3}}
    assert len(json.loads(made[2])["pages"][0]["words"]) == 4 and len(made[11]) == 40 and len(made[0]) == 40
    assert [w["confidence"] for w in three["pages"][0]["words"][1::2]] == [100.0 / 3 / 100] * 1200
    assert three["tables"][0]["cells"][1] == {"rowIndex": 2, "columnIndex": 0, "rowSpan": 2, "content": "2", "kind": "content", "boundingRegions": [{"pageNumber": 1, "polygon": [0.0, 20.0, 9.0, 20.0, 9.0, 28.0, 0.0, 28.0]}]}
    full = spark.createDataFrame([r for r in rows if r[1] and r[4]], ", ".join(map(" ".join, zip(names, types))))
    full.write.parquet(f"{tmp_path}/full/lineitem.parquet")
    con = duck.cursor()
    con.sql(f"CREATE TEMP VIEW lineitem AS SELECT * FROM '{tmp_path}/full/lineitem.parquet/*.parquet'")
    for name in ("layout_documents", "layout_lines", "layout_cells"):
        same_rows(registry.QUERIES[name](spark, f"{tmp_path}/full"), con.sql(registry.ORACLES[name]))
