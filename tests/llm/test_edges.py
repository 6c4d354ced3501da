"""Nulls in any column, empty texts, ties, repeated rows, empty tables and extra columns, for every operator."""

from __future__ import annotations

import pytest

from vatloom.llm import decontaminate, fingerprint, html_text, langid, minhash, mixing, pii, preference, suffix_dedup, suffix_tree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, rep string, component string, kept string, h string"
LONG = "word " * 300 + "tail"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog near the river", "en", "a", 10, "x", "y", "z", "k", "h"),
    (1, "the quick brown fox jumps over the lazy dog near the river", "en", "a", 10, "x", "y", "z", "k", "h"),
    (2, "the quick brown fox jumps over the lazy dog near the river", "en", "a", 10, None, None, None, None, None),
    (3, None, "en", "a", None, None, None, None, None, None),
    (4, "", None, None, 0, None, None, None, None, None),
    (5, LONG, "en", "b", 1, None, None, None, None, None),
    (6, " \t\n\x0b ", "de", None, 1, None, None, None, None, None),
    (None, "hello there write to a.b@example.com or call +49 30 1234567 now", "en", "a", 1, None, None, None, None, None),
    (None, None, None, None, None, None, None, None, None, None),
    (7, "日本 ünï 🙂 🙂 x", "de", "b", 1, None, None, None, None, None),
]
BENCH = [(1, "quick brown fox jumps over the lazy dog near the"), (1, "quick brown fox jumps over the lazy dog near the"), (2, None), (None, "x y z"), (3, ""), (4, "hello")]


def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def op1(spark, d):
    return pii.detect(d)


def op2(spark, d):
    return suffix_tree.score(d)


def op3(spark, d):
    return suffix_dedup.deduplicate(d)


def op4(spark, d):
    return langid.identify(d, langid.fit(langid.training(d)))


def op6(spark, d):
    return mixing.mix(d)


def op7(spark, d):
    return fingerprint.fingerprints(d)


def op9(spark, d):
    return minhash.near_duplicates(d)


OPS = [op1, op2, op3, op4, op6, op7, op9]


@pytest.mark.parametrize("op", OPS)
def test_one_row_a_document(spark, op):
    out = op(spark, docs(spark, ROWS)).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("op", OPS)
def test_empty_table(spark, op):
    assert op(spark, docs(spark, [])).collect() == []


def test_decontaminate(spark):
    d, b = docs(spark, ROWS), spark.createDataFrame(BENCH, "item_id long, text string")
    kept = decontaminate.decontaminate(d, b)
    assert kept.columns == d.columns
    assert sorted(r[0] or 0 for r in kept.collect()) == [0, 0, 3, 4, 5, 6, 7]
    assert decontaminate.decontaminate(docs(spark, []), b).count() == 0
    assert decontaminate.decontaminate(d, b.limit(0)).count() == len(ROWS)


def test_redact(spark):
    d = docs(spark, ROWS)
    out = {(r["doc_id"], r["text"]) for r in pii.redact(d).collect()}
    assert (None, "hello there write to [EMAIL] or call [PHONE] now") in out
    assert (3, None) in out and (4, "") in out
    assert pii.redact(d).columns == d.columns


def test_emit_keeps_columns(spark):
    d = docs(spark, ROWS)
    out = mixing.emit(d)
    assert out.columns[:-1] == d.columns
    plan = mixing.mix(d).agg({"copies": "sum"}).first()[0]
    assert out.count() == plan
    assert mixing.emit(docs(spark, [])).count() == 0


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (None, "u", "<p>x"), (5, "u", "<div <p <<< &amp; &#x; ]]>")], "page_id long, url string, html string")
    out = pages.select("page_id", html_text.extractor(spark)("html").alias("text")).collect()
    assert len(out) == 5 and all(r["text"] is not None for r in out)
    assert pages.limit(0).select(html_text.extractor(spark)("html").alias("text")).count() == 0


def test_preference(spark):
    turns = [(1, 0, "user", "q", "e"), (1, 1, "assistant", "a", "e"), (1, 1, "assistant", "a", "e"), (2, None, None, None, None), (None, 0, "user", "x", None), (3, 0, "assistant", "", None)]
    d = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string, chosen string")
    out = {r["pair_id"]: r for r in preference.format_pairs(preference.with_rejected(d)).collect()}
    assert set(out) == {1, 2, 3}
    assert not out[2]["usable"] and out[2]["chosen"] == ""
    assert out[1]["n_prompt_turns"] == 2 and out[1]["usable"]
    assert preference.format_pairs(preference.with_rejected(d.limit(0))).count() == 0
