"""A layout service's answer (JSON) as rows of the document model: pages, lines with their words, cells, paragraphs and pairs.

The decoded answer is nested three deep (pages, lines, words). Lines take their words by a filter of the page's words:
the mean height of a word lies within the line's. What is looked up in a page stays in the page's row, where lines find their
words before they are exploded, so that a page's words are not copied for each line; pages are exploded, so a task holds one page at a time.
What is asked of an answer as a whole (``documents``) is taken from one decoding of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lists import polygon_points, polygon_span

_SPAN, _POLYGON = "struct<offset:int,length:int>", "array<double>"
_REGIONS = f"array<struct<pageNumber:int,polygon:{_POLYGON}>>"
_WORD = f"struct<content:string,confidence:double,polygon:{_POLYGON},span:{_SPAN}>"
_LINE = f"struct<content:string,polygon:{_POLYGON},spans:array<{_SPAN}>>"
_PAGE = f"struct<pageNumber:int,width:double,height:double,unit:string,angle:double,lines:array<{_LINE}>,words:array<{_WORD}>>"
_CELL = f"struct<rowIndex:int,columnIndex:int,rowSpan:int,columnSpan:int,content:string,kind:string,boundingRegions:{_REGIONS}>"
_TABLE = f"struct<rowCount:int,columnCount:int,cells:array<{_CELL}>,boundingRegions:{_REGIONS}>"
_PARAGRAPH = f"struct<content:string,role:string,boundingRegions:{_REGIONS},spans:array<{_SPAN}>>"
_PART = f"struct<content:string,boundingRegions:{_REGIONS}>"
ANSWER = f"struct<content:string,pages:array<{_PAGE}>,tables:array<{_TABLE}>,paragraphs:array<{_PARAGRAPH}>,keyValuePairs:array<struct<key:{_PART},value:{_PART},confidence:double>>>"
#: What ``documents`` asks of an answer: no tables, of lines and words no more than their texts.
DOCUMENT = "struct<pages:array<struct<pageNumber:int,lines:array<struct<content:string>>,words:array<struct<content:string>>>>,paragraphs:array<struct<content:string,role:string,boundingRegions:array<struct<pageNumber:int>>>>,keyValuePairs:array<struct<key:struct<content:string>,value:struct<content:string>>>>"


def decoded(df: DataFrame, column: str = "json", kind: str = ANSWER) -> DataFrame:
    """Adds ``answer``; a bad blob gives null, and no rows below. ``kind`` names the members that are asked for; others are read over, so no misfit in them counts."""
    return df.withColumn("answer", F.from_json(column, kind))


def _first(regions: Column, what: str) -> Column:
    return F.get(regions, F.lit(0))[what]


def _each(df: DataFrame, items: str | Column, *keep: str) -> DataFrame:
    """``at`` and ``x``, the place and the item of an array, a row each. The outer form with a filter after it: for the inner form the
    optimizer asks first whether the array has items, below the projection that makes it, and so renders and decodes every answer twice."""
    return df.select(*keep, F.posexplode_outer(items).alias("at", "x")).where("at IS NOT NULL")


def pages(df: DataFrame) -> DataFrame:
    """doc_id, page, width, height, unit, angle, full_text (lines joined by blanks)."""
    each = _each(df, "answer.pages", "doc_id").select("doc_id", F.col("x").alias("p"))
    size = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0.0)).alias(c)
    text = F.array_join(F.transform(F.coalesce("p.lines", F.array().cast(f"array<{_LINE}>")), lambda x: x["content"]), " ")
    return each.select("doc_id", F.col("p.pageNumber").alias("page"), size("width"), size("height"), F.col("p.unit").alias("unit"), F.col("p.angle").alias("angle"), text.alias("full_text"))


def lines(df: DataFrame) -> DataFrame:
    """doc_id, page, line_no, text, points, span_offset, span_length, words (text, confidence, points, span_offset, span_length)."""
    each = _each(df, "answer.pages", "doc_id").select("doc_id", F.col("x").alias("p"))
    word = lambda w: F.named_struct(F.lit("text"), w["content"], F.lit("confidence"), w["confidence"], F.lit("points"), polygon_points(w["polygon"]), F.lit("span_offset"), w["span"]["offset"], F.lit("span_length"), w["span"]["length"])
    placed = F.transform(F.coalesce("p.words", F.array().cast(f"array<{_WORD}>")), lambda w: F.named_struct(F.lit("y"), polygon_span(w["polygon"])["mean"], F.lit("w"), word(w)))
    spans = F.transform("p.lines", lambda x: F.named_struct(F.lit("l"), x, F.lit("s"), polygon_span(x["polygon"])))
    on = each.select("doc_id", F.col("p.pageNumber").alias("page"), placed.alias("placed"), spans.alias("spans"))
    mine = lambda s: F.transform(F.filter("placed", lambda x: F.coalesce(x["y"].between(s["low"], s["high"]), F.lit(False))), lambda x: x["w"])
    span = lambda x, c: _first(x["l"]["spans"], c)
    line = lambda x, i: F.struct((i + 1).alias("line_no"), x["l"]["content"].alias("text"), polygon_points(x["l"]["polygon"]).alias("points"), span(x, "offset").alias("span_offset"), span(x, "length").alias("span_length"), mine(x["s"]).alias("words"))
    return _each(on, F.transform("spans", line), "doc_id", "page").select("doc_id", "page", "x.*")


def words(df: DataFrame) -> DataFrame:
    """All words of a page, on a line or not: doc_id, page, word_no, text, confidence, points, span_offset, span_length."""
    each = _each(_each(df, "answer.pages", "doc_id").select("doc_id", F.col("x.pageNumber").alias("page"), F.col("x.words").alias("ws")), "ws", "doc_id", "page").select("doc_id", "page", F.col("at").alias("i"), F.col("x").alias("w"))
    return each.select("doc_id", "page", (F.col("i") + 1).alias("word_no"), F.col("w.content").alias("text"), F.col("w.confidence").alias("confidence"), polygon_points(F.col("w.polygon")).alias("points"), F.col("w.span.offset").alias("span_offset"), F.col("w.span.length").alias("span_length"))


def cells(df: DataFrame) -> DataFrame:
    """doc_id, table_idx, page, n_rows, n_cols, row, col, row_span, col_span (1 where none is given), text, kind, points."""
    each = _each(df, "answer.tables", "doc_id").select("doc_id", F.col("at").alias("table_idx"), F.col("x").alias("t"))
    each = each.select("doc_id", "table_idx", _first(F.col("t.boundingRegions"), "pageNumber").alias("page"), F.col("t.rowCount").alias("n_rows"), F.col("t.columnCount").alias("n_cols"), F.col("t.cells").alias("cs"))
    each = _each(each, "cs", "doc_id", "table_idx", "page", "n_rows", "n_cols").withColumnRenamed("x", "c")
    one = lambda c: F.coalesce(F.col(f"c.{c}"), F.lit(1))
    return each.select("doc_id", "table_idx", "page", "n_rows", "n_cols", F.col("c.rowIndex").alias("row"), F.col("c.columnIndex").alias("col"), one("rowSpan").alias("row_span"), one("columnSpan").alias("col_span"), F.col("c.content").alias("text"), F.col("c.kind").alias("kind"), polygon_points(_first(F.col("c.boundingRegions"), "polygon")).alias("points"))


def paragraphs(df: DataFrame) -> DataFrame:
    """doc_id, paragraph_no, text, role, page, points, span_offset, span_length."""
    each = _each(df, "answer.paragraphs", "doc_id").select("doc_id", F.col("at").alias("paragraph_no"), F.col("x").alias("g"))
    region = lambda c: _first(F.col("g.boundingRegions"), c)
    span = lambda c: _first(F.col("g.spans"), c)
    return each.select("doc_id", "paragraph_no", F.col("g.content").alias("text"), F.col("g.role").alias("role"), region("pageNumber").alias("page"), polygon_points(region("polygon")).alias("points"), span("offset").alias("span_offset"), span("length").alias("span_length"))


def pairs(df: DataFrame) -> DataFrame:
    """doc_id, pair_no, key, value, confidence, page, key_points, value_points."""
    each = _each(df, "answer.keyValuePairs", "doc_id").select("doc_id", F.col("at").alias("pair_no"), F.col("x").alias("k"))
    region = lambda side, c: _first(F.col(f"k.{side}.boundingRegions"), c)
    return each.select("doc_id", "pair_no", F.col("k.key.content").alias("key"), F.col("k.value.content").alias("value"), F.col("k.confidence").alias("confidence"), region("key", "pageNumber").alias("page"), polygon_points(region("key", "polygon")).alias("key_points"), polygon_points(region("value", "polygon")).alias("value_points"))


def documents(df: DataFrame, paragraph, pair) -> DataFrame:
    """doc_id, words (their number on all pages), paragraph (text, role, page), pair (key, value), page, full_text: a row for each page, paragraph and
    pair of an answer, of those paragraphs and pairs that meet the conditions. As a join of the parts by document would, it gives no row of
    an answer that lacks one of them. ``df`` has one row a document, with an answer of the kind ``DOCUMENT`` or larger."""
    g = lambda x: F.struct(x["content"].alias("text"), x["role"].alias("role"), _first(x["boundingRegions"], "pageNumber").alias("page"))
    k = lambda x: F.struct(x["key"]["content"].alias("key"), x["value"]["content"].alias("value"))
    p = lambda x: F.struct(x["pageNumber"].alias("page"), F.array_join(F.coalesce(x["lines"]["content"], F.array().cast("array<string>")), " ").alias("full_text"))
    n = F.aggregate("answer.pages", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.array_size(x["words"]), F.lit(0)))
    some = F.exists("answer.pages", lambda x: F.array_size(x["words"]) > 0)
    parts = df.select("doc_id", F.filter(F.transform("answer.paragraphs", g), paragraph).alias("gs"), F.filter(F.transform("answer.keyValuePairs", k), pair).alias("ks"), F.when(some, F.transform("answer.pages", p)).alias("ps"), n.alias("words"))
    each = _each(parts, "gs", "doc_id", "ks", "ps", "words").withColumnRenamed("x", "paragraph")
    each = _each(each, "ks", "doc_id", "paragraph", "ps", "words").withColumnRenamed("x", "pair")
    return _each(each, "ps", "doc_id", "words", "paragraph", "pair").select("doc_id", "words", "paragraph", "pair", "x.*")


def enriched(base: DataFrame, blobs: DataFrame, raw: bool = False) -> DataFrame:
    """``base`` (doc_id, ...) with lines, paragraphs and pairs of a stored result (doc_id, json), read as a variant: a missing, broken
    or unfit blob, or part of one, gives nulls and leaves the base answer. ``raw`` adds the provider's own answer."""
    v = F.try_parse_json("json")
    part = lambda path, kind: F.try_variant_get(v, path, kind)
    texts = lambda items: F.transform(items, lambda x: x["Text"])
    found = {
        "lines": F.flatten(F.transform(part("$.Pages", "array<struct<Lines:array<struct<Text:string>>>>"), lambda p: texts(p["Lines"]))),
        "paragraphs": texts(part("$.Paragraphs", "array<struct<Text:string>>")),
        "pairs": part("$.KeyValuePairs", "array<struct<KeyText:string,ValueText:string,Confidence:double>>"),
    }
    if raw:
        found["raw_json"] = part("$.RawProviderResponseJson", "string")
    return base.join(blobs.select("doc_id", *[c.alias(k) for k, c in found.items()]), "doc_id", "left")
