"""Fill-in-the-middle against regular expressions, on odd texts and long ones."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st

from vatloom.llm import fill_middle as M
from vatloom.llm.textvec import raw

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plainly(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the contract."""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


TEXTS = [None, "", " ", "a", "<", "<P", "<P>", "x<S>y", "<<M>>", "P>", "<p>", "<P\n>", "<Pa>", "é", "日本語 abc", "áb", "🙂🙂", "ab12cd", "<PS>", "S<P", "\x00a", "line\r\nline", "ÀB", "<M", "M>", "ab<", "ab<P"]


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, fim string")
    return M.transform(df, out="_fim", **options).select("doc_id", "text", "_fim.*", M.restored(M.F.col("_fim.output"), M.F.col("_fim.form")).alias("back")).collect()


def test_odd_texts(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(TEXTS * 12)] + [(None, "no id here", "x", "y"), (7, "same", "x", "y"), (7, "same", "x", "y")]
    got = run(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plainly(r.doc_id, r.text)
        assert r.back == (r.text or "")
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_texts_and_options(spark):
    rows = [(i, ("Ab é<日 12\n" * 700_000)[: 4_000_000 + i], "x", "y") for i in range(3)]
    for r in run(spark, rows, plain_from=100):
        assert r.form != "plain" and r.back == r.text
        n, form, prefix, middle, output = plainly(r.doc_id, r.text)
        if form != "plain":
            assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == (n, form, prefix, middle, output)
    assert {r.form for r in run(spark, [(i, "a b", "x", "y") for i in range(50)], spm_below=100, plain_from=100)} == {"spm"}


def test_empty_table(spark):
    assert run(spark, []) == []


def test_state_depends_on_two_bytes_only():
    kinds = np.arange(8)
    for x in kinds:
        for y in kinds:
            assert len({int(M.NEXT[M.NEXT[s, x], y]) for s in range(4)}) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aPSM<>é日 \n1", max_size=12), max_size=6))
def test_scan_against_regex(texts):
    offsets, data = raw(pa.array(texts, pa.string()))
    emitted = M.scan(offsets, data)
    for t, lo, hi in zip(texts, offsets[:-1], offsets[1:]):
        part = emitted[lo:hi]
        assert int(((part & M.UNIT) > 0).sum()) == len(UNIT.findall(t))
        assert int(((part & M.POINT) > 0).sum()) == len(t)
        assert int(((part & M.SENTINEL) > 0).sum()) == len(re.findall("<[PSM]>", t))


@pytest.mark.parametrize("name", ["op13_fill_middle"])
def test_query_matches_sql(spark, duck, name):
    same_rows(M.op13_fill_middle(spark, SF), duck.sql(M.OP13_SQL))
