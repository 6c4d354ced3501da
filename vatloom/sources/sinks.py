"""Sinks: sheets as DataFrames, CSV and JSON files, date-partitioned storage, and a workbook writer."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import date_strict, money_signed


def documents_sheet(documents: DataFrame, wide: DataFrame, warnings: DataFrame | None = None) -> DataFrame:
    """One row a document (doc_id, file_name, document_type, status, created_at; what is missing is null) in 13 typed columns and
    its number: texts, the date and amounts where they can be read, how many warnings it has, its review label."""
    d = documents.join(wide, "doc_id", "left")
    if warnings is not None:
        d = d.join(warnings.groupBy("doc_id").agg(F.count("*").alias("_warnings")), "doc_id", "left")
    has = lambda c, kind="string": F.col(c) if c in d.columns else F.lit(None).cast(kind)
    amount = lambda c: money_signed(has(c)).cast("decimal(18,2)")
    label = F.when(F.col("status").isin("Reviewed", "Exported"), "Đã duyệt").otherwise("Chưa duyệt")
    texts = {"file_name": "file_name", "document_type": "document_type", "supplier_name": "SupplierName", "supplier_tax_code": "SupplierTaxCode", "invoice_number": "InvoiceNumber"}
    return d.select(
        "doc_id", *[has(c).alias(k) for k, c in texts.items()], date_strict(has("InvoiceDate")).alias("invoice_date"), amount("SubtotalAmount").alias("subtotal"), amount("VatAmount").alias("vat"),
        amount("TotalAmount").alias("total"), has("Currency").alias("currency"), F.coalesce(has("_warnings", "bigint"), F.lit(0)).cast("bigint").alias("warning_count"), label.alias("reviewed"), has("created_at", "timestamp").alias("created_at"),
    )


def in_request_order(df: DataFrame, ids: list[int]) -> DataFrame:
    """Rows in the order in which ids were asked for; others last."""
    asked = df.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in ids])).alias("_pos", "doc_id"))
    return df.join(F.broadcast(asked), "doc_id", "left").orderBy(F.coalesce("_pos", F.lit(1 << 30)), "doc_id").drop("_pos")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; null is blank; quotes doubled."""
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def store(df: DataFrame, path: str, day: str) -> None:
    """Parquet partitioned by year and month of a date column."""
    df.withColumns({"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM")}).write.mode("append").partitionBy("year", "month").parquet(path)


HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_MAIN, _DOC, _PACKAGE = (f"http://schemas.openxmlformats.org/{x}" for x in ("spreadsheetml/2006/main", "officeDocument/2006/relationships", "package/2006"))


def _cell(c: Column, kind: str) -> Column:
    """A column's value as a cell: numbers as such, all else as text without characters that XML forbids."""
    text = F.regexp_replace(c.cast("string"), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
    full = F.concat(F.lit("<c><v>"), text, F.lit("</v></c>")) if number else F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))
    return F.coalesce(full, F.lit("<c/>"))


def _line(cells: list[Column]) -> Column:
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>"))


def write_workbook(sheets: dict[str, DataFrame], path: str, most: int = 1_048_575, order: dict[str, str] | None = None) -> None:
    """An .xlsx at a path of any file system that Spark writes to.

    Tasks write the rows of each sheet as XML, sorted by the column that ``order`` names for the sheet (which isn't shown);
    the driver only copies those files, byte by byte, into the archive. A sheet holds about a million rows, so a larger one
    is refused, not cut.
    """
    spark = next(iter(sheets.values())).sparkSession
    jvm, order = spark._jvm, order or {}
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    parts = jvm.org.apache.hadoop.fs.Path(f"{path}_parts")
    try:
        for i, (name, df) in enumerate(sheets.items(), 1):
            if df.limit(most + 1).count() > most:
                raise ValueError(f"sheet {name} has over {most} rows")
            by = order.get(name)
            shown = [(c, t) for c, t in df.dtypes if c != by]
            rows = (df.orderBy(by) if by else df).select(_line([_cell(F.col(f"`{c}`"), t) for c, t in shown]).alias("value"))
            rows.write.mode("overwrite").text(f"{path}_parts/{i}")
        archive = jvm.java.util.zip.ZipOutputStream(fs.create(target, True))
        try:
            _pack(spark, archive, fs, parts, sheets, order)
        finally:
            archive.close()
    finally:
        fs.delete(parts, True)


def _pack(spark, archive, fs, parts, sheets: dict[str, DataFrame], order: dict[str, str]) -> None:
    jvm, names = spark._jvm, list(sheets)

    def begin(name: str, text: str) -> None:
        archive.putNextEntry(jvm.java.util.zip.ZipEntry(name))
        archive.write(bytearray((HEAD + text).encode()))

    numbers = range(1, len(names) + 1)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers)
    begin("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{types}</Types>')
    begin("_rels/.rels", f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="r1" Type="{_DOC}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
    begin("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{_DOC}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
    begin("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_DOC}"><sheets>' + "".join(f'<sheet name="{escape(n)[:31]}" sheetId="{i}" r:id="s{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
    for i, name in enumerate(names, 1):
        titles = "".join(f'<c t="inlineStr"><is><t>{escape(c)}</t></is></c>' for c in sheets[name].columns if c != order.get(name))
        begin(f"xl/worksheets/sheet{i}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData><row>{titles}</row>')
        files = fs.listStatus(jvm.org.apache.hadoop.fs.Path(parts, str(i)))
        for at in sorted((f.getPath() for f in files), key=lambda p: p.getName()):
            if at.getName().startswith("part-"):
                source = fs.open(at)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, archive, 1 << 16, False)
                source.close()
        archive.write(bytearray(b"</sheetData></worksheet>"))
