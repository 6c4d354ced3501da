"""Typed values from raw text: money, dates, tax codes, rates, currencies, prices. Null where nothing can be read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .textnorm import bind, blank, filled, first_match, last_match, squeeze, strip, strip_marks

DECIMAL = "decimal(38,10)"

# Patterns that decide which part of a text is read.
MONEY = r"(?U)(?=[Vv₫đĐ\s\d])(?iu)(?:VND|VNĐ|₫|đ)?\s*\d+(?:[.,\s]\d{3})*(?:[.,]\d+)?\s*(?:VND|VNĐ|₫|đ)?"
SIGNED_MONEY = r"(?iuU)(?:VND|VNĐ|₫|đ)?\s*-?\d+(?:[.,\s]\d{3})*(?:[.,]\d+)?\s*(?:VND|VNĐ|₫|đ)?"
WHOLE_AMOUNT = r"^[0-9]++(?:\.[0-9]{3})*+\z"
CELL_NUMBER = r"(?U)-?\d+(?:[.,\s]\d{3})*(?:[.,]\d+)?"
DATE = r"(?=\d)(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}-\d{1,2}-\d{1,2})"
STRICT_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\.\d{1,2}\.\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
WORD_DATE = r"(?iuU)(\d{1,2})\s*tháng\s*(\d{1,2})\s*năm\s*(\d{4})"
RATE = r"(?U)(\d+(?:[.,]\d+)?)\s*%"
CURRENCY_CODE = r"(?iuU)\b(VND|VNĐ|USD|EUR|GBP|JPY|CNY)\b"
RATES = ("0%", "5%", "8%", "10%")
MONTHS = "january february march april may june july august september october november december"
NATURES = {"1": "Hóa đơn gốc", "2": "Hóa đơn thay thế", "3": "Hóa đơn điều chỉnh", "4": "Hóa đơn huỷ"}


def _number(c: Column) -> Column:
    return c.try_cast(DECIMAL)


def _grouped(cleaned: Column, plain: Column, simple: bool = False) -> Column:
    """European, then American grouping, then (for cells) a plain decimal, else every mark is grouping."""
    european = F.regexp_replace(F.regexp_replace(cleaned, r"\.", ""), ",", ".")
    american = F.regexp_replace(cleaned, ",", "")
    out = F.when(cleaned.rlike(r"^-?\d{1,3}(\.\d{3})+,\d+$"), _number(european)).when(cleaned.rlike(r"^-?\d{1,3}(,\d{3})+\.\d+$"), _number(american))
    if simple:
        out = out.when(cleaned.rlike(r"^-?\d+\.\d{1,2}$"), _number(cleaned))
    return out.otherwise(_number(plain))


def _money(c: Column, pattern: str, symbols: str) -> Column:
    cleaned = squeeze(F.regexp_replace(last_match(c, pattern), symbols, " "))
    return bind(cleaned, lambda x: _grouped(x, F.regexp_replace(x, "[., ]", "")))


def money(c: Column) -> Column:
    """The last amount in a text: 1.234.567 VND, 1.234,56, 1,234.56; otherwise marks are grouping, so 123,45 is 12345.
    A text of nothing but digits, or digits grouped by dots, is that amount as a whole; one pattern tells."""
    return bind(c, lambda x: F.when(x.rlike(WHOLE_AMOUNT), _number(F.replace(x, F.lit("."), F.lit("")))).otherwise(_money(x, MONEY, r"(?U)[^\d.,\s]")))


def money_signed(c: Column) -> Column:
    """As ``money``, with a minus sign allowed."""
    return _money(c, SIGNED_MONEY, r"(?U)[^\d.,\s-]")


def cell_number(c: Column) -> Column:
    """The first number of a table cell; 10.00 is a decimal here, and blanks between groups can't be read."""
    return bind(first_match(c, CELL_NUMBER), lambda x: _grouped(x, F.regexp_replace(x, "[.,]", ""), simple=True))


def cell_currency(c: Column) -> Column:
    """ISO code in a cell, else by symbol."""
    return bind(c, _symbol)


def _symbol(c: Column) -> Column:
    lower = F.lower(c)
    return (
        F.when(c.rlike(CURRENCY_CODE), F.upper(first_match(c, CURRENCY_CODE)))
        .when(c.contains("₫") | lower.contains("đ"), F.lit("VND"))
        .when(c.contains("$"), F.lit("USD"))
        .when(c.contains("€"), F.lit("EUR"))
        .when(c.contains("£"), F.lit("GBP"))
    )


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.concat(F.lpad(y, 4, "0"), F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")).try_cast("date")


def _year(y: Column) -> Column:
    """Two digits: 00-49 are 2000 on, 50-99 are 1950 on."""
    return F.when(F.length(y) == 2, F.concat(F.when(y < "50", F.lit("20")).otherwise(F.lit("19")), y)).otherwise(y)


def _month(m: Column) -> Column:
    """A month's number; English names, whole or their first three letters."""
    names = F.create_map(*[F.lit(x) for i, month in enumerate(MONTHS.split(), 1) for name in dict.fromkeys((month, month[:3])) for x in (name, str(i))])
    return F.when(m.rlike(r"^\d+$"), m).otherwise(F.try_element_at(names, F.lower(m)))


# The shapes of a date in the order in which they are tried, and the groups that are its year, month and day.
SHAPES = (
    (r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$", (4, 3, 1)),
    (r"^(\d{4})[-/](\d{1,2})[-/](\d{1,2})$", (1, 2, 3)),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})$", (3, 2, 1)),
    (WORD_DATE, (3, 2, 1)),
    # what is left is read month first
    (r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2}|\d{4})$", (3, 1, 2)),
    (r"^(\d{1,2})[-\s]([A-Za-z]{3,9})[-\s](\d{2}|\d{4})$", (3, 2, 1)),
    (r"^([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})$", (3, 1, 2)),
)


def _parse_date(c: Column) -> Column:
    def read(x: Column) -> Column:
        return F.coalesce(*[F.when(x.rlike(p), bind(F.struct(*[F.regexp_extract(x, p, i).alias(n) for n, i in zip("ymd", groups)]), lambda g: _date(_year(g["y"]), _month(g["m"]), g["d"]))) for p, groups in SHAPES])

    return bind(c, read)


def date_loose(c: Column) -> Column:
    """The date of an extracted value; 2024/12/31 is read from its inner part, day first.
    Plain texts 2024-12-31 and 31/12/2024 are read at once; where that is no date, the shapes are tried in their order."""
    iso = lambda x: F.when(x.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), x.try_cast("date"))
    local = lambda x: F.when(x.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z"), _date(F.substr(x, F.lit(7), F.lit(4)), F.substr(x, F.lit(4), F.lit(2)), F.substr(x, F.lit(1), F.lit(2))))
    return bind(c, lambda x: F.coalesce(iso(x), local(x), date_by_shape(x)))


def date_by_shape(c: Column) -> Column:
    return _parse_date(F.coalesce(first_match(c, DATE), strip(c)))


def date_strict(c: Column) -> Column:
    """The date as validation and export read it; also year/month/day."""
    return _parse_date(F.coalesce(first_match(c, STRICT_DATE), strip(c)))


def tax_code(c: Column) -> Column:
    """The digits."""
    digits = F.regexp_replace(c, r"(?U)\D", "")
    return F.when(digits != "", digits)


def currency_code(c: Column) -> Column:
    """VND by any of its marks, else null."""
    return bind(c, _dong)


def _dong(c: Column) -> Column:
    plain = F.upper(strip_marks(c))
    return F.when(~blank(c) & (plain.contains("VND") | plain.contains("DONG") | c.rlike("(?iu)VNĐ|[₫đ]")), F.lit("VND"))


def vat_rate(c: Column) -> Column:
    """KCT, KKKNT, or one of the four rates."""
    value = lambda x: _number(F.regexp_replace(first_match(x, RATE, 1), ",", "."))
    whole = lambda v: F.when(v == F.floor(v), F.concat(v.cast("bigint").cast("string"), F.lit("%")))
    return bind(c, lambda x: bind(F.upper(strip_marks(x)), lambda plain: bind(bind(value(x), whole), lambda rate: _rate(x, plain, rate))))


def _rate(c: Column, plain: Column, rate: Column) -> Column:
    return (
        F.when(blank(c), None)
        .when(plain.contains("KHONG CHIU THUE") | plain.contains("KCT"), F.lit("KCT"))
        .when(plain.contains("KHONG KE KHAI") | plain.contains("KKKNT"), F.lit("KKKNT"))
        .when(rate.isin(*RATES), rate)
    )


def normalized_value(field: Column, raw: Column, normalized: Column) -> Column:
    """A field's normalized value: what it has already, else by field; other fields are trimmed."""
    amounts = field.isin("TotalAmount", "SubtotalAmount", "VatAmount")
    typed = (
        F.when(amounts, plain_decimal(money(raw)))
        .when(field == "InvoiceDate", date_loose(raw).cast("string"))
        .when(field == "SupplierTaxCode", tax_code(raw))
        .when(field == "Currency", currency_code(raw))
        .otherwise(strip(raw))
    )
    return F.coalesce(normalized, typed)


def plain_decimal(c: Column) -> Column:
    """A decimal as text without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def report_date(c: Column) -> Column:
    """ISO dates only."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c.try_cast("date"))


def report_money(c: Column) -> Column:
    return strip(c).try_cast("decimal(18,2)")


def vat_percent(vat: Column, subtotal: Column) -> Column:
    """Whole percent, half away from zero; null without a positive subtotal."""
    return F.when(subtotal > 0, F.round(vat / subtotal * 100, 0).cast("int"))


def confidence_score(base: Column, confidence: Column) -> Column:
    """0.7 of the rule's score and 0.3 of the line's confidence, four digits half-even; the rule's score without one."""
    mixed = F.bround(base * 0.7 + F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)) * 0.3, 4)
    return F.when(confidence.isNull(), base).otherwise(mixed)


def invoice_nature(c: Column) -> Column:
    code = strip(c)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in NATURES.items() for x in kv])[code], code)


def is_xml(content_type: Column, file_name: Column) -> Column:
    return F.lower(file_name).endswith(".xml") | F.lower(content_type).isin("text/xml", "application/xml")


def estimated_cost(content_type: Column, file_name: Column, xml: int = 0, ocr: int = 2) -> Column:
    """Price before processing."""
    return F.when(is_xml(content_type, file_name), F.lit(xml)).otherwise(F.lit(ocr))


def actual_cost(provider: Column, xml: int = 0, text_layer: int = 2, text_layer_llm: int = 2, ocr: int = 2) -> Column:
    """Price by the provider that served the document."""
    return F.when(provider == "TT78Xml", F.lit(xml)).when(provider == "PdfTextLayer", F.lit(text_layer)).when(provider == "PdfTextLayerLlm", F.lit(text_layer_llm)).otherwise(F.lit(ocr))


def page_cost(pages: Column, price: str = "0.01") -> Column:
    return (pages.cast("decimal(18,6)") * F.lit(price).cast("decimal(18,6)")).cast("decimal(18,6)")


def resolved(normalized: Column, raw: Column, rule: str = "R1") -> Column:
    """A field's value. R1: normalized unless blank, else raw; R2: normalized unless null, else raw; R3: normalized."""
    return {"R1": F.coalesce(filled(normalized), raw), "R2": F.coalesce(normalized, raw), "R3": normalized}[rule]
