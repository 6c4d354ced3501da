"""Sources: uploaded files, ground truth and pair CSVs, OCR and claim JSON, and the choice between providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.textnorm import blank, filled, strip
from .named import lines_of

# Kinds of files, their content types, first bytes and size limits.
KINDS = {
    "pdf": (("application/pdf",), "25504446", 20 << 20), "jpg": (("image/jpeg",), "FFD8FF", 20 << 20), "jpeg": (("image/jpeg",), "FFD8FF", 20 << 20),
    "png": (("image/png",), "89504E470D0A1A0A", 20 << 20), "xml": (("text/xml", "application/xml"), "", 5 << 20),
}
GENERIC = ("", "application/octet-stream")
WORD = "struct<Text:string,Confidence:double,BoundingBox:array<struct<X:double,Y:double>>>"
LINE = f"struct<Text:string,Confidence:double,BoundingBox:array<struct<X:double,Y:double>>,Words:array<{WORD}>>"
CELL = "struct<RowIndex:int,ColumnIndex:int,RowSpan:int,ColumnSpan:int,Text:string,Kind:string>"
OCR = (
    "struct<Success:boolean,ErrorMessage:string,ProviderName:string,ModelId:string,ApiVersion:string,Features:array<string>,FullText:string,AverageConfidence:double,"
    f"Pages:array<struct<PageNumber:int,Confidence:double,Lines:array<{LINE}>>>,Fields:array<struct<FieldKey:string,Value:string,Confidence:double,PageNumber:int,RawProviderKey:string>>,"
    f"Paragraphs:array<struct<Text:string,Role:string,PageNumber:int>>,Tables:array<struct<PageNumber:int,RowCount:int,ColumnCount:int,Cells:array<{CELL}>>>,"
    "KeyValuePairs:array<struct<KeyText:string,ValueText:string,Confidence:double,PageNumber:int>>,PageCount:int,ProcessingTimeMs:bigint,EstimatedCost:decimal(18,6)>"
)


def _extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))


def upload_error(name: Column, content_type: Column, size: Column) -> Column:
    """Why an upload is refused; null if it isn't."""
    ext = _extension(name)
    types, limit = F.lit(False), F.lit(20 << 20)
    for k, (names, _, most) in KINDS.items():
        types = types | ((ext == k) & F.lower(content_type).isin(*names, *GENERIC))
        limit = F.when(ext == k, F.lit(most)).otherwise(limit)
    return F.when(size <= 0, "empty").when(~ext.isin(*KINDS), "extension").when(size > limit, "too large").when(~types, "content type")


def worth_sending(name: Column, content_type: Column, size: Column) -> Column:
    """Whether a file can be accepted at all, as far as its name, type and size tell before it is sent: a known content type, or
    none at all for a name that ends in .xml, and not above the limit of its kind. False for null."""
    known = {t for names, _, _ in KINDS.values() for t in names}
    xml = F.lower(name).endswith(".xml")
    limit = F.when(xml, KINDS["xml"][2]).otherwise(KINDS["pdf"][2])
    return F.coalesce(name.isNotNull() & (content_type.isin(*sorted(known)) | ((content_type == "") & xml)) & (size <= limit), F.lit(False))


def signature_ok(name: Column, content: Column) -> Column:
    """Whether the first bytes are those of the file's kind."""
    ok = F.lit(False)
    for k, (_, magic, _) in KINDS.items():
        here = F.lit(True) if not magic else F.hex(F.substring(content, 1, len(magic) // 2)) == magic
        ok = ok | ((_extension(name) == k) & here)
    return ok


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files under a path, by lower-cased path: path, length, content. The pattern can't leave the path."""
    if ".." in path.split("/"):
        raise ValueError("a path may not climb")
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).orderBy(F.lower("path"))


def xml_documents(spark: SparkSession, path: str) -> DataFrame:
    """XML files as (doc_id, xml); the id is the path."""
    return files(spark, path, "*.[xX][mM][lL]").select(F.col("path").alias("doc_id"), F.decode("content", "UTF-8").alias("xml"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth CSV: RFC 4180 in one line a record, trimmed, blank is null; of a file name's rows (without case) the last counts."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    names = {c.strip().lower(): c for c in df.columns}
    rows = df.withColumn("_at", F.monotonically_increasing_id()).select("_at", *[filled(strip(F.col(f"`{c}`"))).alias(c.strip()) for c in names.values()])
    key = names["filename"].strip()
    last = F.row_number().over(Window.partitionBy(F.lower(F.col(key))).orderBy(F.col("_at").desc()))
    return rows.where(~blank(F.col(key))).withColumn("_r", last).where("_r = 1").drop("_r", "_at")


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """XML and PDF pairs; rows without both are left out."""
    df = spark.read.csv(path, header=True, quote='"', escape='"')
    return df.select(filled(strip(F.col("XmlFile"))).alias("XmlFile"), filled(strip(F.col("PdfFile"))).alias("PdfFile")).dropna()


def ocr(df: DataFrame, column: str = "json") -> DataFrame:
    """Decodes stored OCR results (doc_id, json); a bad blob gives nulls."""
    return df.withColumn("ocr", F.from_json(column, OCR))


def ocr_lines(df: DataFrame) -> DataFrame:
    pages = df.select("doc_id", F.col("ocr.AverageConfidence").alias("avg"), F.explode("ocr.Pages").alias("p"))
    lines = pages.select("doc_id", "avg", F.col("p.PageNumber").alias("page"), F.col("p.Confidence").alias("pc"), F.posexplode("p.Lines").alias("i", "l"))
    return lines.select("doc_id", "page", (F.col("i") + 1).alias("line_no"), F.col("l.Text").alias("text"), F.coalesce("l.Confidence", "pc", "avg").alias("confidence"))


def ocr_pairs(df: DataFrame) -> DataFrame:
    each = df.select("doc_id", F.posexplode("ocr.KeyValuePairs").alias("pair_no", "k"))
    return each.select("doc_id", "pair_no", F.col("k.KeyText").alias("key"), F.col("k.ValueText").alias("value"), F.col("k.Confidence").alias("confidence"), F.col("k.PageNumber").alias("page"))


def ocr_cells(df: DataFrame) -> DataFrame:
    tables = df.select("doc_id", F.posexplode("ocr.Tables").alias("table_idx", "t"))
    each = tables.select("doc_id", "table_idx", F.col("t.PageNumber").alias("page"), F.explode("t.Cells").alias("c"))
    return each.select("doc_id", "table_idx", "page", F.col("c.RowIndex").alias("row"), F.col("c.ColumnIndex").alias("col"), F.col("c.Text").alias("text"), F.col("c.Kind").alias("kind"))


def routed(text_layer: DataFrame, ocr_text: DataFrame, least: int = 100) -> DataFrame:
    """The text layer of a document (doc_id, text) where it has ``least`` trimmed characters, else the OCR text."""
    t = text_layer.where(F.length(strip(F.col("text"))) >= least).select("doc_id", F.col("text").alias("layer"))
    o = ocr_text.select("doc_id", F.col("text").alias("scan"))
    both = o.join(t, "doc_id", "full")
    return both.select("doc_id", F.coalesce("layer", "scan").alias("text"), F.when(F.col("layer").isNotNull(), "PdfTextLayer").otherwise("Ocr").alias("provider"))


def fixture(spark: SparkSession, count: int = 1, partitions: int = 1) -> DataFrame:
    """Deterministic documents for tests: lines of a small receipt."""
    return lines_of(spark, "fixture", count=count, partitions=partitions)


LOADERS = {"fixture": fixture, "xml": xml_documents, "files": files}


def loader(name: str | None):
    """A source by configured name; the fixture where none or an unknown one is named."""
    return LOADERS.get((name or "").lower(), fixture)


def known_features(names: Column, known: tuple[str, ...]) -> Column:
    """The known ones of a list of feature names, compared without case."""
    return F.filter(names, lambda n: F.lower(n).isin(*[k.lower() for k in known]))
