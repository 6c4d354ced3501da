"""Edits as rewrites of DataFrames: field upsert, cell patch, tax line replacement, reprocessing, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import resolved, vat_rate
from ..functions.textnorm import strip
from .validate import validate


def upsert_fields(fields: DataFrame, updates: DataFrame, at: Column) -> DataFrame:
    """Fields after updates (doc_id, field_name, value): raw values stay, a changed trimmed value is stored and marked as edited, new names are added."""
    key = ["doc_id", "field_name"]
    u = updates.select(*key, F.col("value").alias("_value"), F.lit(True).alias("_sent"))
    both = fields.join(u, key, "full")
    old, new = strip(resolved(F.col("normalized_value"), F.col("raw_value"), "R2")), strip(F.col("_value"))
    changed = F.coalesce(F.col("_sent"), F.lit(False)) & ~old.eqNullSafe(new)
    return both.select(
        *key, "raw_value", F.when(changed, new).otherwise(F.col("normalized_value")).alias("normalized_value"), "confidence",
        (F.coalesce("is_edited", F.lit(False)) | changed).alias("is_edited"), F.when(changed, at).otherwise(F.col("edited_at")).alias("edited_at"),
    )


def patch_cells(cells: DataFrame, patches: DataFrame) -> DataFrame:
    """Cells with the texts of patches (doc_id, table_idx, row, col, text and, where a cell is patched twice, seq: the last counts); patches of no cell are ignored."""
    key = ["doc_id", "table_idx", "row", "col"]
    order = F.col("seq") if "seq" in patches.columns else F.lit(0)
    last = F.max(F.struct(order.alias("seq"), F.col("text").alias("text")))["text"]
    p = patches.groupBy(*key).agg(last.alias("_text"), F.lit(True).alias("_hit"))
    out = cells.join(p, key, "left")
    return out.withColumn("text", F.when(F.col("_hit"), F.col("_text")).otherwise(F.col("text"))).select(*cells.columns)


def replace_tax_lines(lines: DataFrame, sent: DataFrame, documents: DataFrame) -> DataFrame:
    """Tax lines (doc_id, line_id, raw_rate, vat_rate, ...) after requests: other documents keep theirs; of ``documents``, the
    lines sent (without vat_rate) are what remains. A known id keeps its line, an unknown one or none makes a new line (null id)."""
    keep = lines.join(documents, "doc_id", "left_anti")
    known = lines.select("doc_id", "line_id").distinct().withColumn("_known", F.lit(True))
    now = sent.join(documents, "doc_id", "left_semi").join(known, ["doc_id", "line_id"], "left")
    now = now.withColumn("line_id", F.when(F.col("_known"), F.col("line_id"))).withColumn("vat_rate", vat_rate(F.col("raw_rate")))
    return keep.unionByName(now.select(*lines.columns))


def recomputed(fields: DataFrame, documents: DataFrame, warnings: DataFrame, edited: DataFrame, profile: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Warnings and documents (doc_id, profile, status) after an edit: ``edited`` documents lose all their warnings, get those
    of their present fields, and become Reviewed whatever they were."""
    again = validate(fields.join(edited, "doc_id", "left_semi"), documents.join(edited, "doc_id", "left_semi"), profile, as_of)
    kept = warnings.join(edited, "doc_id", "left_anti")
    mark = documents.join(edited.withColumn("_edited", F.lit(True)), "doc_id", "left")
    return kept.unionByName(again), mark.withColumn("status", F.when(F.col("_edited"), F.lit("Reviewed")).otherwise(F.col("status"))).drop("_edited")


def reprocessed(artifacts: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages, fields, warnings or tax lines without those of documents that start again; logs aren't passed here."""
    return artifacts.join(documents, "doc_id", "left_anti")


def next_status(current: Column, event: Column) -> Column:
    """Status after an event; events that don't apply leave it. An edit always gives Reviewed."""
    return (
        F.when(event == "queued", "Uploaded").when((event == "started") & current.isin("Uploaded", "Failed", "Processed"), "Processing")
        .when((event == "succeeded") & (current == "Processing"), "Processed").when(event == "failed", "Failed")
        .when(event == "edited", "Reviewed").otherwise(current)
    )


def saved(rows: DataFrame, changes: DataFrame, key: str, at: Column) -> DataFrame:
    """Rows after one save of inserts, updates and deletes (``changes``: the columns of rows but created_at and updated_at, and
    ``change``). An inserted row is created at ``at``; a row of which a value changed is stamped with it; a row sent as it is
    keeps its stamp. An insert of a key that exists and an update or delete of one that doesn't change nothing."""
    other = [c for c in rows.columns if c not in (key, "created_at", "updated_at")]
    was = rows.select(key, F.struct(*other).alias("_old"), "created_at", "updated_at", F.lit(True).alias("_is"))
    both = was.join(changes.select(key, F.struct(*other).alias("_new"), "change"), key, "full")
    here, change = F.coalesce("_is", F.lit(False)), F.coalesce("change", F.lit("none"))
    both = both.where(F.when(here, change != "delete").otherwise(change == "insert"))
    new = F.when(here & (change != "update"), F.col("_old")).otherwise(F.col("_new"))
    touched = here & (change == "update") & ~F.col("_old").eqNullSafe(F.col("_new"))
    out = both.select(key, new.alias("_now"), F.when(here, F.col("created_at")).otherwise(at).alias("created_at"), F.when(touched, at).otherwise(F.col("updated_at")).alias("updated_at"))
    return out.select(key, "_now.*", "created_at", "updated_at").select(*rows.columns)
