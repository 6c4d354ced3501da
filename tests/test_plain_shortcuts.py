"""What is read at once gives what the general patterns give; XML is read as far as it is asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from vatloom.functions import normalize as N
from vatloom.functions import textnorm as T
from vatloom.operators import score as S
from vatloom.operators import xmlinvoice as M

TEXTS = (
    None, "", " ", "0", "007", "1.234.567", "1234.567", "0.896", "1.23", "1.2345", "12.345.6", "1.234\n", " 1.234", "1.234,56", "1,234.56", "-5", "9" * 28, "9" * 29, "9" * 40, "٣٤٥", "1.234 VND",
    "2024-12-31", "2024-13-01", "2024-02-30", "0000-01-01", "31/12/2024", "12/31/2024", "31/02/2024", "00/01/2024", "31/12/2024\n", "2024-1-2", "2024/12/31", "31.12.24", "x 2024-12-31",
    "a  b", "a b", "a\tb", "a b", " a ", "a\x1cb", " a\x85", "　 ", "Công ty  đ", "Cong ty, 5", "é́ x", "a   b", "\U0001f600 ", "\x0b\x0ca\r\nb\x0b", "Đ ",
)


def test_shortcuts_change_nothing(spark):
    c = F.col("t")
    squeezed = lambda x: F.trim(F.regexp_replace(x, r"(?U)(?:[^\S ]| (?=\s))\s*", " "))
    stripped = lambda x: F.regexp_replace(x, r"(?Us)^\s*+(.*\S)?\s*+$", "$1")
    table = T.ACCENTS
    marks = F.regexp_replace(F.translate(c, "".join(table), "".join(table.values())), r"\p{Mn}+", "")
    pairs = [(N.money(c), N._money(c, N.MONEY, r"(?U)[^\d.,\s]")), (N.date_loose(c), N.date_by_shape(c)), (T.squeeze(c), squeezed(c)), (T.strip(c), stripped(c)), (T.strip_marks(c), marks)]
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", *[F.struct(a.cast("string").alias("a"), b.cast("string").alias("b")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    for row in df.collect():
        assert all(x["a"] == x["b"] for x in row[1:]), row


def test_where_nothing_is_expected_nothing_is_normalized(spark):
    df = spark.createDataFrame([(None, "5"), (" ", "5"), ("5", "5"), ("5", None)], "e string, a string")
    out = S.matched(df, {"m": ("money", "e", "a")})
    assert [r["m"] for r in out.collect()] == [None, None, True, False]
    assert "CASE WHEN" in out._jdf.queryExecution().optimizedPlan().toString().split("transform(array(")[1][:20]


def test_truth_is_one_aggregate(spark):
    f = spark.createDataFrame([("a", "InvoiceNumber", "1"), ("a", "Currency", "VND"), ("b", "Notes", "x")], "file string, field_name string, raw_value string")
    out = S.truth_from_fields(f)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    got = {r["file"]: r.asDict() for r in out.collect()}
    assert got["a"]["ExpectedInvoiceNumber"] == "1" and got["a"]["ExpectedCurrency"] == "VND" and set(got["b"].values()) == {"b", None}


DOCS = (
    "<HDon><DLHDon Id='L1'><TTChung><SHDon> 7 </SHDon><DVTTe>USD</DVTTe></TTChung><NDHDon><NBan><Ten>A</Ten></NBan><TToan><THTTLTSuat><LTSuat><TSuat>5%</TSuat><ThTien>1</ThTien><TThue>2</TThue></LTSuat></THTTLTSuat><TgTThue>x</TgTThue>"
    "<TTKhac><TTin><TTruong>TotalVATAmount</TTruong><DLieu>9</DLieu></TTin></TTKhac></TToan></NDHDon></DLHDon><MCCQT>M</MCCQT></HDon>",
    "<HDon><In><DLHDon Id='L2'><TTChung><SHDon>8</SHDon></TTChung><NDHDon><TToan><THTTLTSuat><LTSuat><TSuat>KCT</TSuat><ThTien>3</ThTien><TThue>4</TThue></LTSuat></THTTLTSuat><TgTThue>6</TgTThue></TToan></NDHDon></DLHDon></In></HDon>",
    "<HDon><DLHDon><TTChung/><Other><NBan><Ten>B</Ten></NBan><TToan><TgTThue>5</TgTThue></TToan></Other></DLHDon></HDon>",
    "<HDon><DLHDon><NDHDon/></DLHDon></HDon>", "<HDon><DLHDon><!-- x --></DLHDon></HDon>", "<!doctype HDon []><HDon><DLHDon/></HDon>", "<HDon><DLHDon><TTChung></DLHDon></HDon>", "<HDon/>", "", None,
)


def test_xml_read_in_part_gives_the_same_fields(spark):
    df = spark.createDataFrame(list(enumerate(DOCS)), "doc_id long, xml string").cache()
    whole = sorted(map(str, M.fields(df).collect()))
    assert any("TotalVATAmount:Extension" in r for r in whole) and any("'B'" in r for r in whole)
    for n in M.FIELDS:
        assert sorted(map(str, M.fields(df, only=(n,)).collect())) == [r for r in whole if f"field_name='{n}'" in r], n
    every = M.decoded(df).collect()
    for part in (("rates",), ("VatAmount",), ("Currency",)):
        assert [r["xml_status"] for r in M.decoded(df, only=part).collect()] == [r["xml_status"] for r in every]
    assert {(r["doc_id"], r["raw_rate"]) for r in M.tax_lines(df).collect()} == {(0, "5%"), (1, "KCT")}
