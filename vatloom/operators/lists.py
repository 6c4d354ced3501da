"""Reads of documents as lists: tenant, client and status filters, warning counts, pages with totals, latest logs, look-ups, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPORTABLE = ("Processed", "Reviewed")


def of_tenant(df: DataFrame, org_id: int, client_id: int | None = None, statuses: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of one organization; with a client or statuses, only theirs. Plain filters on stored columns, so they reach the scan."""
    out = df.where(F.col("org_id") == org_id)
    if client_id is not None:
        out = out.where(F.col("client_id") == client_id)
    return out.where(F.col("status").isin(*statuses)) if statuses else out


def reportable(documents: DataFrame, org_id: int, client_id: int) -> DataFrame:
    """What a client's reports are made of: Processed and Reviewed documents, purchases and sales alike."""
    return of_tenant(documents, org_id, client_id, REPORTABLE)


def with_warning_count(documents: DataFrame, warnings: DataFrame) -> DataFrame:
    """Documents with ``warning_count``, 0 where there is none."""
    per = warnings.groupBy("doc_id").agg(F.count("*").alias("warning_count"))
    return documents.join(per, "doc_id", "left").withColumn("warning_count", F.coalesce("warning_count", F.lit(0)).cast("bigint"))


def newest(documents: DataFrame, order: str, most: int) -> DataFrame:
    """The newest documents, by number where equal."""
    return documents.orderBy(F.col(order).desc(), F.col("doc_id").desc()).limit(most)


def page_with_total(df: DataFrame, order: list[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page (numbers from 1, sizes 1 to 100) and ``total_count`` of all rows; the count is a one-row join, no window over all rows."""
    number, size = max(1, number), min(100, max(1, size))
    total = df.agg(F.count("*").alias("total_count"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def by_name(df: DataFrame, name: str) -> DataFrame:
    """Rows by name as a dictionary has them: by the root collation without case and marks, then as written. Spark's
    collations have no rule for the crossed d, so it counts as d."""
    plain = F.translate(F.col(name), "đĐ", "dD")
    return df.orderBy(F.collate(plain, "UNICODE_CI_AI"), name)


def latest(logs: DataFrame, key: str = "doc_id", at: str = "created_at") -> DataFrame:
    """The latest row of each key; equal times go to the greatest row."""
    other = [c for c in logs.columns if c not in (key, at)]
    return logs.groupBy(key).agg(F.max(F.struct(at, *other)).alias("_l")).select(key, "_l.*").select(*logs.columns)


def first_per_key(rows: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The first row of each key by its place."""
    other = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*other), ordinal).alias("_f")).select(*key, "_f.*").select(*rows.columns)


def without_candidates(fields: DataFrame, only: tuple[str, ...] = ("VatRate",)) -> DataFrame:
    """Fields without rows that serve as candidates only and aren't stored."""
    return fields.where(~F.col("field_name").isin(*only))


def existing(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``wanted`` with whether a row of the key exists."""
    known = rows.select(key).distinct().withColumn("_known", F.lit(True))
    return wanted.join(known, key, "left").withColumn("exists", F.coalesce("_known", F.lit(False))).drop("_known")


def looked_up(rows: DataFrame, org_id: int, doc_id: int) -> DataFrame:
    """The document of that number if the organization has it; no row otherwise."""
    return rows.where((F.col("org_id") == org_id) & (F.col("doc_id") == doc_id)).limit(1)


def page_confidence(lines: DataFrame) -> DataFrame:
    """Mean confidence of a page's lines; a line without one counts 0."""
    return lines.groupBy("doc_id", "page").agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))


def line_boxes(words: DataFrame) -> DataFrame:
    """The box around the words of each line (x_min, y_min, x_max, y_max)."""
    return words.groupBy("doc_id", "page", "line_no").agg(F.min("x_min").alias("x_min"), F.min("y_min").alias("y_min"), F.max("x_max").alias("x_max"), F.max("y_max").alias("y_max"))


def polygon_points(polygon: Column) -> Column:
    """The points (x, y) of a flat list of x, y, x, y, ...; null below two numbers; an odd number at the end is left out."""
    half = F.floor(F.size(polygon) / 2).cast("int")
    points = F.transform(F.sequence(F.lit(0), half - 1), lambda i: F.named_struct(F.lit("x"), F.get(polygon, i * 2), F.lit("y"), F.get(polygon, i * 2 + 1)))
    return F.when(F.size(polygon) >= 2, points)


def polygon_span(polygon: Column) -> Column:
    """(low, high, mean) of the y of a flat list of x, y, x, y, ...; null below two numbers."""
    y = F.filter(polygon, lambda _x, i: i % 2 == 1)
    mean = F.aggregate(y, F.lit(0.0), lambda s, v: s + v.cast("double"), lambda s: s / F.size(y))
    return F.when(F.size(polygon) >= 2, F.named_struct(F.lit("low"), F.array_min(y), F.lit("high"), F.array_max(y), F.lit("mean"), mean))


def flipped_box(left: Column, bottom: Column, right: Column, top: Column, page_height: Column) -> Column:
    """A rectangle measured from the page's foot as (left, top, width, height) measured from its head."""
    return F.struct(left.alias("left"), (page_height - top).alias("top"), (right - left).alias("width"), (top - bottom).alias("height"))


def token_cost(tokens_in: Column, tokens_out: Column, price_in: str, price_out: str) -> Column:
    """Cost of a language model's call from its tokens, at prices a million tokens."""
    part = lambda n, p: F.coalesce(n, F.lit(0)).cast("decimal(12,0)") * F.lit(p).cast("decimal(10,4)") / F.lit(1_000_000).cast("decimal(7,0)")
    return (part(tokens_in, price_in) + part(tokens_out, price_out)).cast("decimal(18,6)")


# Why a document is not queued.
SHORT = "Không đủ credit (còn %d). Nạp thêm để tiếp tục xử lý."
CAPPED = "Daily credit spending limit reached for this organization. Please try again tomorrow or contact support."


#: Fixed value: what the debug view says of a document.
SUMMARY = "%d page(s), %d table(s), %d field(s), %d warning(s)"


def refusals(decided: DataFrame) -> DataFrame:
    """Charges that the gate decided (doc_id, accepted, balance, amount), with the reason of a refusal; refused documents are not queued."""
    why = F.when(F.col("balance") < F.col("amount"), F.format_string(SHORT, "balance")).otherwise(F.lit(CAPPED))
    return decided.withColumn("refusal", F.when(~F.col("accepted"), why))


def debug_summary(documents: DataFrame, tables: DataFrame, fields: DataFrame, warnings: DataFrame) -> DataFrame:
    """A line of text on each document (doc_id, page_count): its pages, tables (doc_id, table_idx, ...), fields and warnings."""
    counted = lambda rows, name, what=F.lit(1): rows.groupBy("doc_id").agg(F.count(what).alias(name))
    each = tables.groupBy("doc_id").agg(F.count_distinct("table_idx").alias("_t"))
    out = documents.join(each, "doc_id", "left").join(counted(fields, "_f"), "doc_id", "left").join(counted(warnings, "_w"), "doc_id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select("doc_id", F.format_string(SUMMARY, n("page_count"), n("_t"), n("_f"), n("_w")).alias("summary"))


def edits_by_row(patches: DataFrame) -> DataFrame:
    """Cell edits (doc_id, table_idx, row, col, text) gathered by row, in column order."""
    return patches.groupBy("doc_id", "table_idx", "row").agg(F.sort_array(F.collect_list(F.struct("col", "text"))).alias("cells"))


def numbered_warnings(warnings: DataFrame) -> DataFrame:
    """Warnings with their number inside the document, by field and code."""
    return warnings.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("field_name", "code")))


def effective_dates(documents: DataFrame, dates: DataFrame, start: Column, end: Column) -> DataFrame:
    """Documents (doc_id, d) whose invoice date (doc_id, i), or else their own, lies in a period."""
    out = documents.join(dates, "doc_id", "left").withColumn("effective", F.coalesce("i", "d"))
    return out.where(F.col("effective").between(start, end)).drop("i")


def in_order(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows that a request (pos, doc_id) names, with their place in it."""
    return rows.join(F.broadcast(asked), "doc_id")


def missing(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """Ids of a request that no row has."""
    return asked.join(rows.select("doc_id"), "doc_id", "left_anti")


def require_all(asked: DataFrame, rows: DataFrame) -> None:
    """Refuses a request (doc_id) that names documents which no row has. A request is a selection made by hand, a short list."""
    ids = [r["doc_id"] for r in missing(asked, rows).select("doc_id").distinct().orderBy("doc_id").collect()]
    if ids:
        raise KeyError(f"Documents not found: {', '.join(map(str, ids))}")


def exportable(selected: DataFrame, documents: DataFrame) -> DataFrame:
    """What of a selection (doc_id) can be exported: documents that are Processed or Reviewed."""
    return selected.join(documents.where(F.col("status").isin(*REPORTABLE)).select("doc_id"), "doc_id", "left_semi")


def gathered_tables(cells: DataFrame) -> DataFrame:
    """A row a table: its ``cells`` (row, col, text, page, kind) of doc_id, table_idx and these columns. A table is one row, so it must fit in one."""
    cell = F.struct(*[F.col(c) if c in cells.columns else F.lit(None).cast("string").alias(c) for c in ("row", "col", "text", "page", "kind")])
    return cells.groupBy("doc_id", "table_idx").agg(F.collect_list(cell).alias("cells"))


def table_rows(tables: DataFrame) -> DataFrame:
    """Tables (doc_id, table_idx, cells) with ``rows`` (row, cells) in order. Cells are sorted once and cut where the row changes, so that long tables take no longer a cell than short ones."""
    t = tables.withColumn("_sorted", F.sort_array(F.transform("cells", lambda c: F.struct(*[c[x].alias(x) for x in ("row", "col", "text", "page", "kind")]))))
    new = F.transform("_sorted", lambda c, i: F.when((i == 0) | ~F.get("_sorted", i - 1)["row"].eqNullSafe(c["row"]), i))
    t = t.withColumn("_starts", F.filter(new, lambda i: i.isNotNull()))
    row = lambda s, j: F.struct(F.get("_sorted", s)["row"].alias("row"), F.slice("_sorted", s + 1, F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - s).alias("cells"))
    return t.select("doc_id", "table_idx", F.transform("_starts", row).alias("rows"))
