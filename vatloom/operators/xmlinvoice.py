"""E-invoice XML to fields and tax lines.

A document is decoded once, by ``from_xml`` with the schema of an invoice; prefixes are ignored and every element is
an array, so that the first of repeated ones counts, and fields are looked up in that tree. An invoice in another
place than below the root, or with a block that the tree lacks although the text names it, is read by XPath over local
names instead; both give the same texts, so what follows doesn't know which was used. Malformed input and any DOCTYPE
are refused. The invoice is the first DLHDon that has no Signature above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import DECIMAL, invoice_nature, plain_decimal, vat_rate
from ..functions.textnorm import strip

ROOT = "//*[local-name()='DLHDon'][not(ancestor-or-self::*[local-name()='Signature'])]"

# Field, block, tag.
TEXT_FIELDS = (
    ("InvoiceNumber", "TTChung", "SHDon"), ("InvoiceDate", "TTChung", "NLap"), ("SupplierTaxCode", "NBan", "MST"), ("SupplierName", "NBan", "Ten"), ("SupplierAddress", "NBan", "DChi"),
    ("BuyerTaxCode", "NMua", "MST"), ("BuyerName", "NMua", "Ten"), ("BuyerAddress", "NMua", "DChi"), ("InvoiceForm", "TTChung", "KHMSHDon"), ("InvoiceSymbol", "TTChung", "KHHDon"),
    ("PaymentMethod", "TTChung", "HTTToan"), ("AmountInWords", "TToan", "TgTTTBChu"),
)
MONEY_FIELDS = (
    ("SubtotalAmount", "TgTCThue", ("TotalAmountWithoutVAT", "TotalSaleAmount")), ("VatAmount", "TgTThue", ("TotalVATAmount",)), ("TotalAmount", "TgTTTBSo", ("TotalAmount",)),
)


_TEXTS = "array<string>"
_RATE = "struct<TSuat:array<string>,ThTien:array<string>,TThue:array<string>>"
_EXTRA = "array<struct<TTin:array<struct<TTruong:array<string>,DLieu:array<string>>>>>"


#: The texts that each field is made of, where they aren't named as the field.
SOURCES = {n: (n, *[f"{x}:Extension" for x in names]) for n, _, names in MONEY_FIELDS} | {"TaxAuthorityCode": ("MCCQT",), "LookupCode": ("Id",), "InvoiceNature": ("TCHDon",), "Currency": ("DVTTe",), "DocumentType": ()}
FIELDS = (*[n for n, _, _ in TEXT_FIELDS], "TaxAuthorityCode", "LookupCode", *[n for n, _, _ in MONEY_FIELDS], "InvoiceNature", "Currency", "DocumentType")


def _tags(wanted: set[str]) -> dict[str, dict[str, str]]:
    """The wanted texts that are children of a block, by block: text, tag."""
    every = [*TEXT_FIELDS, ("TCHDon", "TTChung", "TCHDon"), ("DVTTe", "TTChung", "DVTTe"), *[(n, "TToan", tag) for n, tag, _ in MONEY_FIELDS]]
    return {b: {n: tag for n, at, tag in every if at == b and n in wanted} for b in ("TTChung", "NBan", "NMua", "TToan")}


def _extensions(wanted: set[str]) -> list[str]:
    return [n for _, _, names in MONEY_FIELDS for n in names if f"{n}:Extension" in wanted]


def _schema(wanted: set[str]) -> str:
    """The tree of an invoice as far as the wanted texts need it: other elements are passed over."""
    tags = {b: [f"{tag}:{_TEXTS}" for tag in found.values()] for b, found in _tags(wanted).items()}
    tags["TToan"] += [f"THTTLTSuat:array<struct<LTSuat:array<{_RATE}>>>"] * ("rates" in wanted) + [f"TTKhac:{_EXTRA}"] * bool(_extensions(wanted))
    block = {b: f"{b}:array<struct<{','.join(x)}>>" for b, x in tags.items() if x}
    inner = [block[b] for b in ("NBan", "NMua", "TToan") if b in block]
    root = ["_Id:string", *[block[b] for b in ("TTChung",) if b in block], *[f"NDHDon:array<struct<{','.join(inner)}>>" for _ in (1,) if inner]]
    return f"DLHDon array<struct<{','.join(root)}>>, {f'MCCQT {_TEXTS}, ' if 'MCCQT' in wanted else ''}_corrupt_record string"


def _name(tag: str) -> str:
    return f"*[local-name()='{tag}']"


def _first(c: Column, *tags: str) -> Column:
    for t in tags:
        c = F.get(c[t], F.lit(0))
    return c


def _filled(c: Column) -> Column:
    """Trimmed text; null if absent or blank."""
    return F.nullif(strip(c), F.lit(""))


def _typed(x: Column, wanted: set[str]) -> Column:
    """The wanted texts, from the decoded tree."""
    root, tags, extensions = _first(x, "DLHDon"), _tags(wanted), _extensions(wanted)
    block = lambda b: _first(root, "TTChung") if b == "TTChung" else _first(root, "NDHDon", b)
    texts = {name: _first(block(b), tag) for b, found in tags.items() for name, tag in found.items()}
    texts |= {"MCCQT": _first(x, "MCCQT")} if "MCCQT" in wanted else {}
    texts |= {"Id": root["_Id"]} if "Id" in wanted else {}
    named = lambda n: F.get(F.filter(_first(block("TToan"), "TTKhac")["TTin"], lambda e: F.get(e["TTruong"], F.lit(0)) == n), F.lit(0))
    texts |= {f"{n}:Extension": _first(named(n), "DLieu") for n in extensions}
    more = []
    if "rates" in wanted:
        more.append(F.transform(_first(block("TToan"), "THTTLTSuat")["LTSuat"], lambda r: F.struct(*[F.get(r[t], F.lit(0)).alias(t) for t in ("TSuat", "ThTien", "TThue")])).alias("rates"))
    return F.struct(*[_filled(texts[k]).alias(k) for k in sorted(texts)], *more)


def _by_path(xml: Column, wanted: set[str]) -> Column:
    """The same texts by XPath."""
    text = lambda path: F.xpath_string(xml, F.lit(path))
    child = lambda b, t: text(f"(({ROOT})[1]//{_name(b)})[1]/{_name(t)}[1]")
    total = f"(({ROOT})[1]//{_name('TToan')})[1]"
    texts = {name: child(b, tag) for b, found in _tags(wanted).items() for name, tag in found.items()}
    texts |= {"MCCQT": text(f"(//{_name('MCCQT')}[not(ancestor::{_name('Signature')})])[1]")} if "MCCQT" in wanted else {}
    texts |= {"Id": text(f"({ROOT})[1]/@Id")} if "Id" in wanted else {}
    texts |= {f"{n}:Extension": text(f"{total}//{_name('TTin')}[{_name('TTruong')}='{n}'][1]/{_name('DLieu')}[1]") for n in _extensions(wanted)}
    more = []
    if "rates" in wanted:
        path = f"{total}//{_name('THTTLTSuat')}[1]/{_name('LTSuat')}"
        place = F.sequence(F.lit(1), F.xpath_int(xml, F.lit(f"count({path})")))
        values = {t: F.xpath(xml, F.lit(f"{path}/{_name(t)}/text()")) for t in ("TSuat", "ThTien", "TThue")}
        more.append(F.when(F.xpath_boolean(xml, F.lit(path)), F.transform(place, lambda i: F.struct(*[F.get(v, i - 1).alias(t) for t, v in values.items()]))).alias("rates"))
    return F.struct(*[_filled(texts[k]).alias(k) for k in sorted(texts)], *more)


def decoded(df: DataFrame, xml: str = "xml", only: tuple[str, ...] = (*FIELDS, "rates")) -> DataFrame:
    """Adds ``xml_status``: ok, no invoice, or unreadable (malformed, DOCTYPE, null); and ``texts``, null unless ok. One parse a document,
    which reads what the fields in ``only`` (or its rate lines, ``rates``) are made of."""
    wanted = {t for f in only for t in SOURCES.get(f, (f,))}
    # only what has a declaration can have a DOCTYPE, and a substring is found far faster than a pattern
    refused = F.coalesce(F.col(xml).contains("<!") & F.col(xml).rlike("(?i)<!DOCTYPE"), F.lit(True))
    tree = F.from_xml(F.when(~refused, F.col(xml)), _schema(wanted), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "ignoreNamespace": "true"})
    x = F.col("_tree")
    bad = x.isNull() | x["_corrupt_record"].isNotNull()
    root = _first(x, "DLHDon")
    blocks = {b for b, found in _tags(wanted).items() if found} | ({"TToan"} if "rates" in wanted or _extensions(wanted) else set())
    inner = lambda: _first(root, "NDHDon")
    missing = {}  # what the tree may lack, by the tag that the text names then
    missing |= {"TTChung": root["TTChung"]} if "TTChung" in blocks else {}
    missing |= {b: inner()[b] for b in ("NBan", "NMua", "TToan") if b in blocks}
    missing |= {"MCCQT": x["MCCQT"]} if "MCCQT" in wanted else {}
    missing |= {"THTTLTSuat": _first(inner(), "TToan")["THTTLTSuat"]} if "rates" in wanted else {}
    missing |= {"TTin": _first(inner(), "TToan")["TTKhac"]} if _extensions(wanted) else {}
    elsewhere = F.lit(False)
    for tag, found in missing.items():
        elsewhere = elsewhere | (found.isNull() & F.col(xml).contains(tag))
    plain = root.isNotNull() & ~elsewhere
    there = F.col(xml).contains("DLHDon") & F.xpath_boolean(xml, F.lit(ROOT))
    status = F.when(bad, "unreadable").when(plain, "plain").when(there, "elsewhere").otherwise("no invoice")
    read = df.withColumn("_tree", tree).withColumn("_status", status)
    texts = F.when(F.col("_status") == "plain", _typed(x, wanted)).when(F.col("_status") == "elsewhere", _by_path(F.col(xml), wanted)) if wanted else F.lit(None)
    ok = F.when(F.col("_status").isin("plain", "elsewhere"), "ok").otherwise(F.col("_status"))
    return read.withColumns({"texts": texts, "xml_status": ok}).drop("_tree", "_status")


def readable(df: DataFrame, xml: str = "xml") -> DataFrame:
    """Adds ``xml_status`` and ``safe_xml``, which is null unless the document is well-formed and without DOCTYPE."""
    out = decoded(df, xml).drop("texts")
    return out.withColumn("safe_xml", F.when(F.col("xml_status") != "unreadable", F.col(xml)))


def _field(name: str, raw: Column, normalized: Column, confidence: float, provider: Column | None) -> Column:
    provider = F.lit(None).cast("string") if provider is None else provider
    return F.struct(F.lit(name).alias("field_name"), raw.cast("string").alias("raw_value"), normalized.cast("string").alias("normalized_value"), F.lit(confidence).alias("confidence"), provider.cast("string").alias("provider_field"))


def _money_field(name: str, tag: str, names: tuple[str, ...]) -> Column:
    """An amount: the tag, else the provider's extension entries by name; the first that is a number, else the tag's text."""
    t = F.col("texts")
    sources = [(t[name], tag), *[(t[f"{n}:Extension"], f"{n}:Extension") for n in names]]
    raw, provider = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, source in reversed(sources):
        number = text.try_cast(DECIMAL).isNotNull()
        raw, provider = F.when(number, text).otherwise(raw), F.when(number, F.lit(source)).otherwise(provider)
    raw, provider = F.coalesce(raw, t[name]), F.when(raw.isNull() & t[name].isNotNull(), F.lit(tag)).otherwise(provider)
    return _field(name, raw, plain_decimal(raw.try_cast(DECIMAL)), 1.0, provider)


def fields(df: DataFrame, xml: str = "xml", only: tuple[str, ...] = FIELDS) -> DataFrame:
    """doc_id, field_name, raw_value, normalized_value, confidence, provider_field of every readable invoice; with ``only``, no other fields are read."""
    null, t = F.lit(None), F.col("texts")
    found = {n: lambda n=n, tag=tag: _field(n, t[n], null, 1.0, F.lit(tag)) for n, _, tag in TEXT_FIELDS}
    found |= {"TaxAuthorityCode": lambda: _field("TaxAuthorityCode", t["MCCQT"], null, 1.0, F.lit("MCCQT")), "LookupCode": lambda: _field("LookupCode", t["Id"], null, 1.0, F.lit("Id"))}
    found |= {m[0]: lambda m=m: _money_field(*m) for m in MONEY_FIELDS}
    nature = lambda: t["TCHDon"]
    found["InvoiceNature"] = lambda: F.when(nature().isNotNull(), _field("InvoiceNature", nature(), invoice_nature(nature()), 1.0, F.lit("TCHDon"))).otherwise(_field("InvoiceNature", null, invoice_nature(F.lit("1")), 0.5, None))
    found["Currency"] = lambda: _field("Currency", F.coalesce(t["DVTTe"], F.lit("VND")), null, 1.0, F.when(t["DVTTe"].isNotNull(), F.lit("DVTTe")))
    found["DocumentType"] = lambda: _field("DocumentType", F.lit("VatInvoice"), null, 1.0, None)
    read = only if set(only) - {"DocumentType"} else (*only, "LookupCode")  # the type alone needs a readable invoice too
    each = decoded(df, xml, read).select("doc_id", F.when(t.isNotNull(), F.array(*[found[n]() for n in FIELDS if n in only])).alias("_found"))
    return each.select("doc_id", F.inline_outer("_found")).where("raw_value IS NOT NULL OR normalized_value IS NOT NULL")


def tax_lines(df: DataFrame, xml: str = "xml") -> DataFrame:
    """doc_id, sort_order, raw_rate, vat_rate, taxable_amount, tax_amount of each rate line in order."""
    each = decoded(df, xml, ("rates",)).select("doc_id", F.posexplode_outer("texts.rates").alias("sort_order", "l")).where("sort_order IS NOT NULL")
    amount = lambda tag: strip(F.col(f"l.{tag}")).try_cast("decimal(18,2)")
    return each.select("doc_id", "sort_order", F.col("l.TSuat").alias("raw_rate"), vat_rate(F.col("l.TSuat")).alias("vat_rate"), amount("ThTien").alias("taxable_amount"), amount("TThue").alias("tax_amount"))
