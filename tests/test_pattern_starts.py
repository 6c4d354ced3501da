"""Patterns that begin with what a match can begin with find what they found without."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from vatloom.functions import normalize as N
from vatloom.operators import rules as R

TEXTS = ("Tổng cộng: 1.234 VND", "vnđ 5", "ĐƠN đ 7", "₫9", "tỔNG 8", "MST: 0123456789", "tax code 12345678 9", "ſố HĐ HD-1", "ınvoıce no: A12", "vat 10", "Subtotal 3", "1.2.2024 Biên lai", "5-MAR-1999", "hóa đơn", "", "none")


@pytest.mark.parametrize("pattern", [N.MONEY, N.DATE, R.DATE_VALUE, R.TAX_CODE_TEXT, R.NUMBER_TEXT, R.TOTAL_TEXT, R.VAT_TEXT, R.SUBTOTAL_TEXT, R.INVOICE_TITLE, R.RECEIPT_TITLE])
def test_same_matches(spark, pattern):
    assert "(?=" in pattern
    plain = re.sub(r"\(\?=(\[[^\]]*\]|\\d)\)", "", pattern, count=1)
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    found = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (pattern, plain)]
    assert all(a == b for a, b in df.select(*found).collect())
