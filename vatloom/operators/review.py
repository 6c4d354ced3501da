"""Review tables, line items and the mapping of fields to a profile's sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normalize import cell_currency, cell_number, resolved
from ..functions.textnorm import bind, blank, contains_any, filled, humanize, search_text, strip
from . import rules as R
from .lists import gathered_tables, table_rows

TABLE = ["doc_id", "table_idx"]


def column_kind(label: Column) -> Column:
    """The canonical column that a header names; null for none."""

    def named(s: Column) -> Column:
        out = F.when(s == "", None)
        for kind, words in R.TABLE_COLUMNS.items():
            out = out.when(contains_any(s, words), F.lit(kind))
        return out

    return bind(search_text(label, underscore=True), named)


def header_rows(cells: DataFrame) -> DataFrame:
    """The header row of each table: the first with more header cells than others, else the lowest row."""
    rows = cells.groupBy(*TABLE, "row").agg((F.count_if(F.lower("kind") == "columnheader") / F.count("*") > 0.5).alias("h"))
    return rows.groupBy(*TABLE).agg(F.coalesce(F.min(F.when(F.col("h"), F.col("row"))), F.min("row")).alias("header_row"))


def columns(cells: DataFrame) -> DataFrame:
    """doc_id, table_idx, col, label, column_key, kind; a key used before gets the column's number."""
    headers = cells.join(header_rows(cells), TABLE).where("row = header_row").select(*TABLE, "col", F.coalesce("text", F.lit("")).alias("label"))
    width = cells.groupBy(*TABLE).agg((F.max("col") + 1).alias("width"))
    every = width.select(*TABLE, F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))
    named = every.join(headers, [*TABLE, "col"], "left").withColumn("label", F.coalesce("label", F.lit(""))).withColumn("kind", column_kind(F.col("label")))
    key = F.coalesce("kind", F.concat(F.lit("col"), F.col("col").cast("string")))
    again = F.row_number().over(Window.partitionBy(*TABLE, "_key").orderBy("col")) > 1
    return named.withColumn("_key", key).withColumn("column_key", F.when(again, F.concat("_key", F.lit("_"), F.col("col").cast("string"))).otherwise(F.col("_key"))).select(*TABLE, "col", "label", "column_key", "kind")


def line_items(cells: DataFrame) -> DataFrame:
    """Items of tables that have a description and a numeric column; numbered across a document's tables."""
    return items(gathered_tables(cells))


def items(tables: DataFrame) -> DataFrame:
    """``line_items`` of whole tables (doc_id, table_idx, cells): header, columns and rows are found inside each, with no join or exchange."""
    header = lambda r: r["row"].isNotNull() & (F.size(F.filter(r["cells"], lambda c: F.lower(c["kind"]) == "columnheader")) / F.size(r["cells"]) > 0.5)
    head = F.coalesce(F.get(F.filter("rows", header), F.lit(0)), F.get(F.filter("rows", lambda r: r["row"].isNotNull()), F.lit(0)))
    named = lambda cells: F.transform(F.filter(cells, lambda c: c["col"] >= 0), lambda c: F.struct(c["col"].alias("col"), column_kind(F.coalesce(c["text"], F.lit(""))).alias("kind")))
    at = lambda found, k: F.array_min(F.transform(F.filter(found, lambda c: c["kind"] == k), lambda c: c["col"]))
    first = lambda h: bind(named(h["cells"]), lambda found: F.struct(h["row"].alias("header_row"), *[at(found, k).alias(k) for k in R.TABLE_COLUMNS]))
    t = table_rows(tables).withColumn("first", bind(head, first))
    usable = F.col("first.Description").isNotNull() & F.coalesce("first.Quantity", "first.UnitPrice", "first.Amount").isNotNull()
    # an outer inline, and no condition before it: either would be asked below the projections, which would run twice
    body = F.when(usable, F.filter("rows", lambda r: r["row"] != F.col("first.header_row")))
    rows = t.select(*TABLE, "first", F.inline_outer(body)).where("row IS NOT NULL")
    pick = lambda k: F.array_max(F.transform(F.filter("cells", lambda c: c["col"] == F.col(f"first.{k}")), lambda c: c["text"])).alias(f"t_{k}")
    rows = rows.select(*TABLE, "row", *[pick(k) for k in R.TABLE_COLUMNS])
    rows = rows.withColumn("description", strip(F.col("t_Description"))).where(~blank(F.col("description")))
    rows = rows.where(~bind(search_text(F.col("description"), underscore=True), lambda s: contains_any(s, R.TABLE_FOOTER)))
    numbers = {k: cell_number(F.col(f"t_{k}")).cast("decimal(18,4)") for k in ("Quantity", "UnitPrice", "Amount")}
    failed = [F.when(~blank(F.col(f"t_{k}")) & v.isNull(), F.concat(F.lit(f"{k} could not be parsed from \""), F.col(f"t_{k}"), F.lit('".'))) for k, v in numbers.items()]
    warnings = F.filter(F.array(*failed), lambda w: w.isNotNull())
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("table_idx", "row"))
    return rows.select(
        "doc_id", number.alias("line_number"), "table_idx", "row", "description", *[v.alias(k.lower()) for k, v in numbers.items()],
        cell_currency(F.coalesce("t_Amount", "t_UnitPrice")).alias("currency"), F.when(F.size(warnings) > 0, 0.4).otherwise(0.75).alias("confidence"), warnings.alias("warnings"),
    )


def table_width(cells: DataFrame) -> int:
    """Columns of the widest table; 0 without any."""
    return cells.agg(F.coalesce(F.max("col") + 1, F.lit(0)).alias("w")).first()["w"]


def table_sheet(cells: DataFrame, width: int | None = None) -> DataFrame:
    """One row a table row, columns padded to ``width``, or to the widest table; of cells at one place the first text by order counts."""
    width = table_width(cells) if width is None else width
    rows = cells.groupBy(*TABLE, "row")
    if not width:
        return rows.agg(F.lit(1)).select(*TABLE, "row")
    return rows.pivot("col", list(range(width))).agg(F.min("text")).select(*TABLE, "row", *[F.coalesce(F.col(str(i)), F.lit("")).alias(f"c{i}") for i in range(width)])


def mapped(fields: DataFrame, documents: DataFrame, profile: DataFrame) -> DataFrame:
    """Every profile field of each document (doc_id, profile) with its value: the key's field, else the alias's; missing ones stay with nulls. Fields no profile field takes come last, in section ``other``."""
    values = fields.select("doc_id", "field_name", resolved(F.col("normalized_value"), F.col("raw_value"), "R2").alias("value"), "confidence")
    held = values.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("value", "confidence")))).alias("m"))
    wanted = documents.join(F.broadcast(profile), "profile").join(held, "doc_id", "left")
    source = F.when(F.col("m")[F.col("field_key")].isNotNull(), F.col("field_key")).when(F.col("m")[F.col("alias")].isNotNull(), F.col("alias"))
    placed = wanted.withColumn("source", source)
    hit = F.col("m")[F.col("source")]
    inside = placed.select("doc_id", "section", "section_order", "field_key", "field_order", "required", "source", hit["value"].alias("value"), hit["confidence"].alias("confidence"))
    taken = placed.where("source IS NOT NULL").select("doc_id", F.col("source").alias("field_name"))
    rest = values.join(taken, ["doc_id", "field_name"], "left_anti").where("field_name <> 'DocumentType'")
    other = rest.select("doc_id", F.lit("other").alias("section"), F.lit(99).alias("section_order"), F.col("field_name").alias("field_key"), F.lit(0).alias("field_order"), F.lit(False).alias("required"), F.col("field_name").alias("source"), "value", "confidence")
    return inside.unionByName(other)


def labelled(mapping: DataFrame) -> DataFrame:
    return mapping.withColumn("label", humanize(F.col("field_key")))


def overall_confidence(mapping: DataFrame) -> DataFrame:
    """Mean confidence of a document's fields that have one."""
    return mapping.groupBy("doc_id").agg(F.avg("confidence").alias("overall_confidence"))


def field_warnings(mapping: DataFrame, warnings: DataFrame, profile: DataFrame) -> DataFrame:
    """Warnings of a review field by its key or alias, gathered."""
    names = profile.select("field_key", "alias").distinct()
    keyed = warnings.where("field_name IS NOT NULL").join(F.broadcast(names), (F.col("field_name") == F.col("field_key")) | (F.col("field_name") == F.col("alias")))
    per = keyed.groupBy("doc_id", "field_key").agg(F.sort_array(F.collect_set("code")).alias("codes"))
    return mapping.join(per, ["doc_id", "field_key"], "left")


def ocr_tax_line(fields: DataFrame, rate: Column) -> DataFrame:
    """One tax line from an OCR document's rate marker and its amounts."""
    pick = lambda n: F.max(F.when(F.col("field_name") == n, resolved(F.col("normalized_value"), F.col("raw_value"))))
    wide = fields.groupBy("doc_id").agg(pick("VatRate").alias("raw_rate"), pick("SubtotalAmount").alias("s"), pick("VatAmount").alias("v"), F.max(F.when(F.col("field_name") == "VatRate", F.col("confidence"))).alias("confidence"))
    got = wide.where(filled(F.col("raw_rate")).isNotNull())
    return got.select("doc_id", "raw_rate", rate.alias("vat_rate"), F.col("s").try_cast("decimal(18,2)").alias("taxable_amount"), F.col("v").try_cast("decimal(18,2)").alias("tax_amount"), "confidence", F.lit(0).alias("sort_order"))
