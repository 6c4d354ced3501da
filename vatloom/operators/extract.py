"""Candidate generators over document lines, pairs, paragraphs and cells, and the choice of one winner a field.

Inputs are long DataFrames keyed by ``doc_id``. All candidates have one shape, so the generators are
projections and the winner is one grouped maximum: confidence, then source priority, then
insertion order (stage, position, rule). ``position`` is the line's place in its document, from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import MONEY, confidence_score
from ..functions.textnorm import apart, bind, blank, clean_value, contains_any, filled, first_match, last_match, search_text, split_lines, squeeze, strip, truncate, value_after_label, with_clean_values, with_search_text
from . import rules as R
from .lists import gathered_tables, polygon_span, table_rows

CANDIDATE = ("doc_id", "field_name", "raw_value", "confidence", "page", "priority", "method", "source_text", "source_type", "provider_field", "stage", "position", "rule")
CANDIDATE_TYPE = "struct<field_name:string,raw_value:string,confidence:double,page:int,priority:int,method:string,source_text:string,source_type:string,provider_field:string,stage:int,rule:int>"
TOP_LINE = "SupplierTopLine"
AMOUNTS = ("SubtotalAmount", "VatAmount", "TotalAmount")


#: Matches joined lines if one of them is blank; then they are looked at one by one.
MAY_BE_BLANK = r"(?U)(?:^|\n)\s*(?:\n|$)"


def compact(search: Column) -> Column:
    """Search text without blanks, where hints of patterns are looked for."""
    return F.replace(search, F.lit(" "), F.lit(""))


def _hinted(pattern: str, hint: Column) -> Column:
    return contains_any(hint, R.HINTS[pattern])


def _matches(text: Column, pattern: str, hint: Column) -> Column:
    return _hinted(pattern, hint) & text.rlike(pattern)


def amount_field(search: Column) -> Column:
    """The amount field that a label names: tax, subtotal or total; null for none."""
    return (
        F.when(contains_any(search, R.VAT), F.lit("VatAmount"))
        .when(contains_any(search, R.SUBTOTAL), F.lit("SubtotalAmount"))
        .when(contains_any(search, tuple(R.TOTAL_WEIGHTS)), F.lit("TotalAmount"))
    )


def total_weight(search: Column) -> Column:
    best = F.lit(0)
    for keyword, weight in R.TOTAL_WEIGHTS.items():
        best = F.greatest(best, F.when(search.contains(keyword), F.lit(weight)).otherwise(F.lit(0)))
    return best


def _candidate(field, value: Column, confidence: Column, priority: int, method: str, source: Column, *, stage: int, page: Column | None = None, kind: str = "Line", provider: Column | None = None, rule: int = 0) -> Column:
    null = F.lit(None)
    return F.struct(
        (F.lit(field) if isinstance(field, str) else field).alias("field_name"), value.alias("raw_value"), confidence.cast("double").alias("confidence"),
        (null if page is None else page).cast("int").alias("page"), F.lit(priority).alias("priority"), F.lit(method).alias("method"), truncate(source).alias("source_text"),
        F.lit(kind).alias("source_type"), (null if provider is None else provider).cast("string").alias("provider_field"), F.lit(stage).alias("stage"), F.lit(rule).alias("rule"),
    )


def _spread(df: DataFrame, position: Column, found: Column) -> DataFrame:
    """One row a non-blank candidate of an array. The array is a column of its own beside a bound one, which keeps both out of
    whole-stage code: there they would be one method, too large to be compiled; here they are split into small ones."""
    rows = df.select("doc_id", bind(position.cast("int"), lambda x: x).alias("position"), found.alias("_found")).select("doc_id", "position", F.inline_outer("_found"))
    return rows.where(~blank(F.col("raw_value"))).select(*CANDIDATE)


def _chosen(rules: list[tuple[tuple[str, ...], Column]], only: tuple[str, ...] | None) -> Column:
    """The candidates of rules that can give a wanted field; all of them without a wish. A currency may follow from the amounts."""
    if only is not None:
        only = (*only, *AMOUNTS) if "Currency" in only else only
        rules = [r for r in rules if set(r[0]) & set(only)]
    return F.array(*[c for _, c in rules]) if rules else F.array().cast(f"array<{CANDIDATE_TYPE}>")


def gathered(lines: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """A row a document: its full ``text`` and its ``lines`` (page, line_no, text, confidence) in order, without blank ones.

    ``texts`` (doc_id, text, confidence) are the full texts as they were read; where a document has none, its lines joined.
    A document without lines has those of its full text, on page 1. A document is one row, so it must fit in one.
    Rules cost far more than bytes suggest, so the exchange keeps the session's number of partitions and isn't merged.
    """
    lines = lines.repartition(int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    line = F.struct("page", "line_no", "text", "confidence")
    docs = lines.withColumns({"page": F.col("page").cast("int"), "line_no": F.col("line_no").cast("int"), "confidence": F.col("confidence").cast("double")}).groupBy("doc_id").agg(F.sort_array(F.collect_list(line)).alias("every"))
    joined = F.array_join(F.transform("every", lambda x: x["text"]), "\n")
    own = F.filter("every", lambda x: ~blank(x["text"]))
    if texts is None:
        return docs.select("doc_id", joined.alias("text"), own.alias("lines"))
    both = docs.join(texts.select("doc_id", F.col("text").alias("whole"), F.col("confidence").cast("double").alias("mean")), "doc_id", "full")
    split = F.transform(split_lines(F.col("whole")), lambda x, i: F.struct(F.lit(1).alias("page"), i.alias("line_no"), x.alias("text"), F.col("mean").alias("confidence")))
    found = both.select("doc_id", F.coalesce("whole", joined).alias("text"), own.alias("own"), split.alias("split"))
    return found.select("doc_id", "text", F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce("split", "own")).alias("lines"))


def documents(rows: DataFrame) -> DataFrame:
    """What ``gathered`` gives, from rows that hold a whole document already: doc_id and ``lines``, an array in order of (page, line_no, text, confidence)."""
    own = F.when(F.array_join("lines.text", "\n", "").rlike(MAY_BE_BLANK), F.filter("lines", lambda x: ~blank(x["text"]))).otherwise(F.col("lines"))
    return rows.select("doc_id", F.array_join("lines.text", "\n").alias("text"), own.alias("lines"))


def _searched(rows: DataFrame) -> DataFrame:
    return with_search_text(rows).withColumn("compact", compact(F.col("search")))


#: Letters that patterns without case take for an ASCII letter and search text doesn't; in a text without them, a pattern that matches has its hint.
FOLDED = ("ı", "ſ")


def numbered_lines(docs: DataFrame, whole: bool = True, hinted: bool = True) -> DataFrame:
    """Each line with search text, place, count, the next line and the flags and values that rules ask for; and, if ``whole``, the full text, at place -1.
    Unless ``hinted``, a full text has search text only where a pattern may match without its hint."""
    # arrays are zipped, not transformed: a lambda is interpreted for every line, this is compiled
    kinds, line = docs.schema["lines"].dataType.elementType, F.col("lines")
    if whole:
        line = F.concat(line, F.array(F.struct(*[(F.col("text") if f.name == "text" else F.lit(None).cast(f.dataType)).alias(f.name) for f in kinds])))
    rows = docs.select("doc_id", F.size("lines").alias("n_lines"), line.alias("line"), F.slice("lines.text", 2, F.greatest(F.size("lines"), F.lit(1))).alias("after"))
    rows = rows.select("doc_id", "n_lines", F.posexplode_outer(F.arrays_zip("line", "after")).alias("at", "_row"))
    position = F.when(F.col("at") == F.col("n_lines"), -1).otherwise(F.col("at")) if whole else F.col("at")
    of = lambda name, kind: F.col(f"_row.{name}").cast(kind)
    rows = rows.select("doc_id", "n_lines", of("line.page", "int").alias("page"), of("line.text", "string").alias("text"), of("line.confidence", "double").alias("confidence"), position.alias("position"), of("after", "string").alias("next_text"))
    sought = F.lit(True) if hinted else (F.col("position") >= 0) | contains_any(F.col("text"), FOLDED)
    rows = with_search_text(rows.withColumn("_sought", F.when(sought, F.col("text"))), "_sought").drop("_sought")
    line = apart(F.col("position")) >= 0  # no rule asks for a whole text's flags
    rows = rows.withColumn("compact", F.when(F.col("position") < 0, compact(F.col("search")))).withColumns({f"has_{k}": F.when(line, contains_any(F.col("search"), words)) for k, words in _FLAGS.items()} | {"amount_field": F.when(line, amount_field(F.col("search")))})
    labelled = F.coalesce(F.nullif(value_after_label(F.col("text")), F.lit("")), apart(F.col("next_text")))
    rows = rows.withColumns(_line_matches())
    return with_clean_values(rows, {"labelled": F.when(F.col("has_supplier") | F.col("has_po") | F.col("has_notes"), labelled), "marked": F.when(F.col("has_company"), F.col("text"))})


def line_context(lines: DataFrame | None, docs: DataFrame | None = None) -> DataFrame:
    """Lines (doc_id, page, line_no, text, confidence) with search text, place, count and the next line. ``docs`` (see ``documents``) instead of ``lines``: no exchange gathers them."""
    return numbered_lines(gathered(lines) if docs is None else docs, whole=False).where("position >= 0")


#: Keywords that rules ask for.
_FLAGS = {
    "supplier": R.SUPPLIER, "tax_code": R.TAX_CODE, "number": R.INVOICE_NUMBER, "date": R.INVOICE_DATE, "due": R.DUE_DATE, "po": R.PO_NUMBER, "vat": R.VAT, "notes": R.NOTES,
    "company": R.COMPANY, "address": R.ADDRESS, "no_vendor": R.NOT_A_VENDOR,
}


def _line_matches() -> dict[str, Column]:
    """What a line's own text gives where its keywords ask for it; empty, or null for an amount, where the line after is to be searched.
    As columns, so that each is found once: under a rule's condition, a match would be found again wherever the rule uses it."""
    text, search, has = apart(F.col("text")), F.col("search"), lambda flag: F.col(f"has_{flag}")
    return {
        "own_tax_code": F.when(has("tax_code"), F.regexp_extract(text, R.TAX_CODE_VALUE, 0)),
        "own_number": F.when(has("number") & ~search.contains("ma so thue"), F.regexp_extract(F.coalesce(value_after_label(F.col("text")), text), R.NUMBER_VALUE, 0)),
        "own_date": F.when(has("date") | has("due"), F.regexp_extract(text, R.DATE_VALUE, 0)),
        "own_amount": F.when(F.col("amount_field").isNotNull() & ~search.contains("in words"), last_match(text, MONEY)),
    }


def line_rules(top_lines: bool = True) -> list[tuple[tuple[str, ...], Column]]:
    """Keyword rules on a line and the line after, and at last the rule on top lines: the fields that each can give, and the candidate."""
    text, search, after, page = F.col("text"), F.col("search"), F.col("next_text"), F.col("page")
    score = lambda base: confidence_score(base if isinstance(base, Column) else F.lit(base), F.col("confidence"))
    labelled, marked = F.col("labelled"), F.col("marked")  # clean, and null on lines of other rules
    near = lambda own, pattern: F.when(F.col(own) != "", F.col(own)).otherwise(F.regexp_extract(after, pattern, 0))
    field, own = F.col("amount_field"), F.col("own_amount")
    amount = F.coalesce(own, last_match(after, MONEY))
    place = F.when(F.col("n_lines") > 1, F.col("position") / (F.col("n_lines") - 1) * 0.05).otherwise(F.lit(0.0))
    total = F.least(F.lit(0.97), F.lit(0.88) + (total_weight(search) - 1) * 0.03 + place)
    has = lambda flag: F.col(f"has_{flag}")

    def rule(number: int, names, cond: Column, value: Column, base, priority: int, method: str = "LineKeyword", source: Column = text, stage: int = 5):
        named = (names,) if isinstance(names, str) else AMOUNTS  # under the condition as a whole, or patterns run on lines without the label
        return named, F.when(cond, _candidate(names, value, score(base), priority, method, source, stage=stage, page=page, rule=number))

    keywords = [
        rule(1, "SupplierName", has("supplier"), labelled, 0.88, 60),
        rule(2, "SupplierTaxCode", has("tax_code"), near("own_tax_code", R.TAX_CODE_VALUE), 0.9, 70),
        rule(3, "InvoiceNumber", has("number") & ~search.contains("ma so thue"), near("own_number", R.NUMBER_VALUE), F.when(search == "so", 0.72).otherwise(0.86), 55),
        rule(4, "InvoiceDate", has("date") & ~has("due"), near("own_date", R.DATE_VALUE), 0.86, 55),
        rule(5, "DueDate", has("due"), near("own_date", R.DATE_VALUE), 0.86, 55),
        rule(6, "PONumber", has("po"), labelled, 0.84, 55),
        rule(7, field, ~search.contains("in words") & field.isNotNull(), amount, F.when(field == "TotalAmount", total).otherwise(0.84), 65, source=F.when(own.isNotNull(), text).otherwise(after)),
        rule(8, "VatRate", has("vat"), F.regexp_extract(text, R.RATE_MARKER, 0), 0.8, 60),
        rule(9, "Notes", has("notes"), labelled, 0.78, 35),
        rule(10, "SupplierName", (F.col("position") < 10) & has("company") & ~has("supplier"), marked, 0.72, 30, "SupplierMarker"),
    ]
    top = rule(0, "SupplierName", (F.col("position") < 6) & likely_merchant(text), clean_value(text), 0.68, 20, TOP_LINE, stage=7)
    return [*keywords, top] if top_lines else keywords


def from_lines(context: DataFrame, only: tuple[str, ...] | None = None, top_lines: bool = True) -> DataFrame:
    """Keyword rules on single lines and the line after, and top lines that can be a merchant's name, of which the first counts;
    these are looked for in every line, at more cost than keywords, so they are left out where ``top_lines`` aren't asked for."""
    return _spread(context, F.col("position"), _chosen(line_rules(top_lines), only))


def likely_merchant(text: Column) -> Column:
    """Whether a line can be a merchant's name, by its flags and shape."""
    marked = F.lit(False)
    for flag in _FLAGS:
        marked = marked | F.col(f"has_{flag}") if flag not in ("vat", "company") else marked

    def shaped(t: Column) -> Column:
        digits, solid = F.length(F.regexp_replace(t, r"(?U)\D", "")), F.length(F.regexp_replace(t, r"(?U)\s", ""))
        return (F.length(t) >= 3) & t.rlike(r"\p{L}") & ~t.rlike(r"(?U)^\d") & (digits <= solid * 0.5)

    def titled(t: Column, hint: Column) -> Column:
        return _matches(t, R.INVOICE_TITLE, hint) | _matches(t, R.RECEIPT_TITLE, hint) | t.rlike(R.DATE_VALUE)

    return ~marked & F.col("amount_field").isNull() & bind(strip(text), lambda t: shaped(t) & ~bind(compact(F.col("search")), lambda hint: titled(t, hint)))


def from_top_lines(context: DataFrame) -> DataFrame:
    """The first of the first six lines that can be a merchant's name."""
    every = _spread(context, F.col("position"), F.array(line_rules()[-1][1]))
    first = F.min_by(F.struct(*[c for c in CANDIDATE if c != "doc_id"]), "position")
    return every.groupBy("doc_id").agg(first.alias("f")).select("doc_id", "f.*").select(*CANDIDATE)


def from_pairs(pairs: DataFrame) -> DataFrame:
    """Key-value pairs (doc_id, pair_no, key, value, confidence, page): the first rule that the key meets."""
    pairs = pairs.where(~blank(F.col("value"))).withColumn("_search", search_text(F.col("key")))
    key, value = F.col("_search"), F.col("value")
    has = lambda words: contains_any(key, words)
    amount = amount_field(key)
    or_all = lambda pattern: F.coalesce(filled(first_match(value, pattern)), value)
    is_amount = ~key.contains("in words") & amount.isNotNull()
    field = F.when(has(R.TAX_CODE), "SupplierTaxCode").when(has(R.SUPPLIER), "SupplierName").when(has(R.INVOICE_DATE), "InvoiceDate").when(is_amount, amount).when(has(R.INVOICE_NUMBER), "InvoiceNumber").when(has(R.NOTES), "Notes")
    raw = (
        F.when(has(R.TAX_CODE), or_all(R.TAX_CODE_VALUE)).when(has(R.SUPPLIER), clean_value(value)).when(has(R.INVOICE_DATE), or_all(R.DATE_VALUE))
        .when(is_amount, last_match(value, MONEY)).when(has(R.INVOICE_NUMBER), or_all(R.NUMBER_VALUE)).when(has(R.NOTES), clean_value(value))
    )
    source = F.concat(F.coalesce("key", F.lit("")), F.lit(": "), value)
    found = _candidate(field, raw, F.coalesce("confidence", F.lit(0.9)), 105, "KeyValuePair", source, stage=1, page=F.col("page"), kind="KeyValuePair", provider=F.col("key"))
    return _spread(pairs, F.col("pair_no"), F.array(found)).where("field_name IS NOT NULL")


def from_provider(fields: DataFrame) -> DataFrame:
    """Provider fields (doc_id, field_no, key, value, confidence, page) by the fixed key map."""
    names = F.create_map(*[F.lit(x) for k, v in R.PROVIDER_KEYS.items() for x in (k.lower(), v)])
    field = names[F.lower("key")]
    found = _candidate(field, F.col("value"), F.coalesce("confidence", F.lit(0.9)), 100, "ProviderField", F.col("value"), stage=2, page=F.col("page"), kind="ProviderField", provider=F.col("key"))
    rows = _spread(fields, F.col("field_no"), F.array(found))
    return rows.where("field_name IS NOT NULL")


_TEXT_RULES = (
    ("SupplierTaxCode", R.TAX_CODE_TEXT, 1), ("InvoiceNumber", R.NUMBER_TEXT, 1), ("InvoiceDate", R.DATE_VALUE, 0),
    ("TotalAmount", R.TOTAL_TEXT, 1), ("VatAmount", R.VAT_TEXT, 1), ("SubtotalAmount", R.SUBTOTAL_TEXT, 1),
)


def _with_matches(rows: DataFrame, here: Column | None = None) -> DataFrame:
    """What patterns find in a text, where ``here`` holds: matches as columns, so that each is found once, however often a rule uses it.
    With search text, a pattern's hint is looked for first; the kind of a document is told from it."""
    text, here = apart(F.col("text")), F.lit(True) if here is None else here
    hint = F.col("compact")
    found = lambda p: F.when((here & (hint.isNull() | _hinted(p, hint))) if p in R.HINTS else here, F.regexp_extract(text, p, 0))
    kind = F.when(here, document_type(F.col("text"), F.col("search"), F.col("compact")))
    return rows.withColumns({f"match_{i}": found(p) for i, (_, p, _) in enumerate(_TEXT_RULES)} | {"match_currency": found(R.CURRENCY_MARKER), "match_kind": kind})


def _text_rules(bases: tuple[float, ...], priority: int, method: str, stage: int, page: Column | None) -> list[tuple[tuple[str, ...], Column]]:
    rules = []
    for i, ((field, p, g), base) in enumerate(zip(_TEXT_RULES, bases)):
        found = F.col(f"match_{i}")
        value = F.regexp_extract(found, p, g) if g else found  # a pattern that gave a match gives the same on the match
        rules.append(((field,), F.when(found != "", _candidate(field, value, F.lit(base), priority, method, found, stage=stage, page=page, kind="Regex", rule=i))))
    return rules


def full_text_rules() -> list[tuple[tuple[str, ...], Column]]:
    return _text_rules((0.64, 0.62, 0.60, 0.62, 0.60, 0.60), 10, "FullTextRegex", 3, None)


def from_full_text(texts: DataFrame) -> DataFrame:
    """Patterns over the whole text (doc_id, text)."""
    return _spread(_with_matches(_searched(texts)), F.lit(0), _chosen(full_text_rules(), None))


def from_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Patterns over paragraphs (doc_id, paragraph_no, text, page)."""
    rules = _text_rules((0.68, 0.66, 0.64, 0.66, 0.64, 0.64), 15, "ParagraphRegex", 4, F.col("page"))
    return _spread(_with_matches(_searched(paragraphs)), F.col("paragraph_no"), _chosen(rules, None))


def from_table_footers(cells: DataFrame) -> DataFrame:
    """Table rows (doc_id, table_idx, page, row, col, text) with an amount label: the right-most other cell with a number, else the label's own."""
    return from_tables(gathered_tables(cells))


def from_tables(tables: DataFrame) -> DataFrame:
    """``from_table_footers`` of whole tables (doc_id, table_idx, cells). Only rows with a label leave their table: other cells are neither sorted with them nor searched for numbers."""
    named = lambda c: F.struct(c["col"].alias("col"), c["text"].alias("text"), c["page"].alias("page"), bind(search_text(F.coalesce(c["text"], F.lit(""))), amount_field).alias("field"))
    is_label = lambda c: c["field"].isNotNull() & c["col"].isNotNull()
    each = F.transform("rows", lambda r: F.struct(r["row"].alias("row"), F.transform(r["cells"], named).alias("cells")))
    rows = table_rows(tables).select("doc_id", "table_idx", F.size("rows").alias("n_rows"), F.inline_outer(F.filter(each, lambda r: F.exists(r["cells"], is_label)))).where("cells IS NOT NULL")
    valued = lambda c: F.struct(c["col"].alias("col"), c["field"].alias("field"), c["text"].alias("text"), last_match(F.coalesce(c["text"], F.lit("")), MONEY).alias("value"))
    rows = rows.select("doc_id", "table_idx", "n_rows", "row", F.get("cells", F.lit(0))["page"].alias("page"), F.transform("cells", valued).alias("cells"))
    rows = rows.withColumn("label", F.array_min(F.filter("cells", is_label)))
    others = F.filter("cells", lambda c: c["value"].isNotNull() & (c["col"] != F.col("label.col")))
    rows = rows.withColumn("best", F.array_max(F.transform(others, lambda c: F.struct(c["col"].alias("col"), c["text"].alias("text"), c["value"].alias("value")))))
    value = F.coalesce("best.value", "label.value")
    bonus = F.when(F.col("n_rows") > 1, F.col("row") / (F.col("n_rows") - 1) * 0.05).otherwise(F.lit(0.0))
    score = F.least(F.lit(0.9), F.when(F.col("label.field") == "TotalAmount", 0.8).otherwise(0.76) + bonus)
    source = F.concat(F.col("label.text"), F.lit(" | "), F.coalesce("best.text", "label.text"))
    found = _candidate(F.col("label.field"), value, score, 40, "TableFooter", source, stage=6, page=F.col("page"), kind="Table")
    return _spread(rows, F.col("table_idx") * 100000 + F.col("row"), F.array(found))


def document_type(text: Column, search: Column, hint: Column | None = None) -> Column:
    """The first outcome of the cascade, most specific first; null for none. ``hint`` is the search text without blanks."""
    hint, has = compact(search) if hint is None else hint, search.contains
    match = lambda pattern: _matches(text, pattern, hint)
    return (
        F.when(match(R.APP_RECEIPT) | has("ma don hang"), "AppReceiptScreenshot")
        .when(match(R.RESTAURANT), "RestaurantBill")
        .when(has("hoa don ban hang"), "PosReceipt")
        .when(match(R.RECEIPT_TITLE) | has("bien lai") | has("phieu thu") | has("receipt"), "Receipt")
        .when(has("gia tri gia tang"), "VatInvoice")
        .when(match(R.COMMERCIAL), "CommercialInvoice")
        .when(match(R.INTERNATIONAL), "InternationalInvoice")
        .when(match(R.INVOICE_TITLE) | has("hoa don") | has("invoice"), "Invoice")
    )


def whole_rules() -> list[tuple[tuple[str, ...], Column]]:
    """Document type and currency marker of a whole text, with what was found in it."""
    kind, marker = F.col("match_kind"), F.col("match_currency")
    return [
        (("DocumentType",), _candidate("DocumentType", kind, F.lit(0.84), 45, "DocumentTypeHeuristic", kind, stage=8, kind="Heuristic", rule=0)),
        (("Currency",), _candidate("Currency", marker, F.lit(0.78), 35, "CurrencyHeuristic", marker, stage=8, kind="Heuristic", rule=1)),
    ]


def from_whole(texts: DataFrame) -> DataFrame:
    """Document type and currency marker of a whole text (doc_id, text)."""
    return _spread(_with_matches(_searched(texts)), F.lit(0), _chosen(whole_rules(), None))


_WON = ("raw_value", "confidence", "page", "priority", "method", "source_text", "source_type", "provider_field")


def _winners(candidates: DataFrame, *more: Column, keep: tuple[str, ...] = _WON) -> DataFrame:
    """Of a document's top lines only the first is a candidate, so it is found beside the best of the others."""
    ok = candidates.where(~blank(F.col("raw_value")) & ~((F.col("field_name") == "InvoiceNumber") & F.col("raw_value").rlike(R.URL_LIKE)))
    rank = F.struct(F.coalesce("confidence", F.lit(0.0)), "priority", -F.col("stage"), -F.col("position"), -F.col("rule"))
    top, won = F.col("method").eqNullSafe(TOP_LINE), F.struct(rank.alias("rank"), F.struct(*keep).alias("w"))
    others = F.max_by(F.when(~top, won), F.when(~top, rank))
    first = F.min_by(F.when(top, won), F.when(top, F.struct("position", "stage", "rule")))
    both = ok.groupBy("doc_id", "field_name").agg(others.alias("_o"), first.alias("_f"), *more)
    better = F.col("_o").isNull() | (F.col("_f.rank") > F.col("_o.rank"))
    return both.withColumn("w", F.when(F.col("_f").isNotNull() & better, F.col("_f.w")).otherwise(F.col("_o.w"))).drop("_o", "_f")


def resolve(candidates: DataFrame, keep: tuple[str, ...] = _WON) -> DataFrame:
    """The winner of each field: highest confidence (null is 0), then priority, then first inserted. URL-like invoice numbers don't count.
    Of the winners ``keep`` is given; candidates are sorted with nothing else, so a task holds less of them."""
    return _winners(candidates, keep=keep).select("doc_id", "field_name", "w.*")


def resolve_with_default(candidates: DataFrame, keep: tuple[str, ...] = _WON) -> DataFrame:
    """Winners, and VND where no currency was found and an amount, winner or not, is grouped by dots. Candidates that lie
    together by document need no further exchange: the currency is told from the winners of the document."""
    grouped = F.max(F.col("field_name").isin(*AMOUNTS) & F.col("raw_value").rlike(R.GROUPED_MONEY))
    won = _winners(candidates, grouped.alias("grouped"), keep=keep)
    each = F.struct("field_name", "w.*")
    docs = won.groupBy("doc_id").agg(F.collect_list(each).alias("all"), F.max(F.col("field_name") == "Currency").alias("known"), F.max("grouped").alias("grouped"))
    default = _candidate("Currency", F.lit("VND"), F.lit(0.5), 5, "CurrencyDefault", F.lit(None).cast("string"), stage=9, kind="Heuristic")
    extra = F.array(F.struct(*[default[c].alias(c) for c in ("field_name", *keep)]))
    return docs.select("doc_id", F.inline(F.when(F.col("grouped") & ~F.col("known"), F.concat("all", extra)).otherwise(F.col("all"))))


def full_text(lines: DataFrame) -> DataFrame:
    """Lines joined in order."""
    return gathered(lines.withColumn("confidence", F.lit(None).cast("double"))).select("doc_id", "text")


def extract(lines: DataFrame | None, pairs: DataFrame | None = None, fields: DataFrame | None = None, paragraphs: DataFrame | None = None, cells: DataFrame | None = None, texts: DataFrame | None = None, only: tuple[str, ...] | None = None, docs: DataFrame | None = None, keep: tuple[str, ...] = _WON) -> DataFrame:
    """All generators over one batch of documents, and the winners. With ``only``, rules that can't give these fields don't run.
    ``docs`` (see ``documents``) instead of ``lines`` and ``texts``: no exchange gathers them. ``keep``: see ``resolve``.

    Lines are gathered by document once; every rule on lines and texts is one projection of them, so without other sources
    that one exchange is all.
    """
    hinted = only is None or bool({"DocumentType", "Currency"} & set(only))
    rows = _with_matches(numbered_lines(gathered(lines, texts) if docs is None else docs, hinted=hinted), F.col("position") < 0)
    found = F.when(F.col("position") >= 0, _chosen(line_rules(), only)).otherwise(_chosen([*full_text_rules(), *whole_rules()], only))
    every = _spread(rows, F.greatest("position", F.lit(0)), found)
    others = [f(x) for f, x in ((from_pairs, pairs), (from_provider, fields), (from_paragraphs, paragraphs), (from_table_footers, cells)) if x is not None]
    for p in others:
        every = every.unionByName(p)
    every = every.repartition("doc_id") if others else every
    won = resolve_with_default(every, keep) if only is None or "Currency" in only else resolve(every, keep)
    return won if only is None else won.where(F.col("field_name").isin(*only))


def words_to_lines(words: DataFrame, factor: float = 0.6, least: float = 1.0) -> DataFrame:
    """Greedy clustering of words (doc_id, page, text, x, y, height) into lines: from top to bottom, a word joins while it is within
    max(factor * height of the line's first word, least) of the running mean of y. Gives doc_id, page, line_no, text."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("y")).alias("k"), "x", "y", "height", "text")))

    def step(acc: Column, w: Column) -> Column:
        near = (F.size(acc["line"]) > 0) & (F.abs(w["y"] - acc["sum"] / F.size(acc["line"])) <= acc["tol"])
        fresh = F.struct(F.when(F.size(acc["line"]) > 0, F.concat(acc["done"], F.array(acc["line"]))).otherwise(acc["done"]).alias("done"), F.array(F.struct(w["x"].alias("x"), w["text"].alias("text"))).alias("line"), w["y"].alias("sum"), F.greatest(w["height"] * factor, F.lit(least)).alias("tol"))
        joined = F.struct(acc["done"].alias("done"), F.concat(acc["line"], F.array(F.struct(w["x"].alias("x"), w["text"].alias("text")))).alias("line"), (acc["sum"] + w["y"]).alias("sum"), acc["tol"].alias("tol"))
        return F.when(near, joined).otherwise(fresh)

    kind = "array<struct<x:double,text:string>>"
    zero = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.array().cast(kind).alias("line"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("tol"))
    grouped = words.withColumns({c: F.col(c).cast("double") for c in ("x", "y", "height")}).groupBy("doc_id", "page").agg(ordered.alias("ws"))
    lines = F.aggregate("ws", zero, step, lambda acc: F.concat(acc["done"], F.array(acc["line"])))
    each = grouped.select("doc_id", "page", F.posexplode(lines).alias("i", "line"))
    return each.select("doc_id", "page", (F.col("i") + 1).alias("line_no"), squeeze(F.array_join(F.transform(F.array_sort("line"), lambda w: w["text"]), " ")).alias("text"))


def words_on_lines(words: DataFrame, lines: DataFrame) -> DataFrame:
    """Words (doc_id, page, word_no, y) whose middle lies between a line's top and bottom (doc_id, page, line_no, y_min, y_max); a word may be on several."""
    return words.join(lines, ["doc_id", "page"]).where(F.col("y").between(F.col("y_min"), F.col("y_max"))).select("doc_id", "page", "word_no", "line_no")


def polygon_words(words: DataFrame, lines: DataFrame, step: float = 1.0) -> DataFrame:
    """Words (doc_id, page, word_no, polygon) on lines (doc_id, page, line_no, polygon): the mean of a word's heights lies within a
    line's, ends included; polygons below two numbers are on nothing. A line is laid into every band of ``step`` that it crosses, a
    word into its own, so that a full page joins band by band and not every word with every line."""
    band = lambda y: F.floor(y / step)
    w = words.withColumn("_s", polygon_span(F.col("polygon"))).where("_s IS NOT NULL").select("doc_id", "page", "word_no", F.col("_s.mean").alias("_y"), band(F.col("_s.mean")).alias("_band"))
    spans = lines.withColumn("_s", polygon_span(F.col("polygon"))).where("_s IS NOT NULL")
    ln = spans.select("doc_id", "page", "line_no", F.col("_s.low").alias("_low"), F.col("_s.high").alias("_high"), F.explode(F.sequence(band(F.col("_s.low")), band(F.col("_s.high")))).alias("_band"))
    return w.join(ln, ["doc_id", "page", "_band"]).where(F.col("_y").between(F.col("_low"), F.col("_high"))).select("doc_id", "page", "word_no", "line_no")
