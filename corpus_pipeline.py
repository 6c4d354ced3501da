"""From raw documents to a training mix: five stages, each over all that the one before kept.

An empty table passes every stage and stays empty. Extra columns are kept by all of them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vatloom.llm import decontaminate, langid, minhash, mixing, pii
from vatloom.llm.common import staged, table, unused

#: A prediction below this share counts as no language.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts among them) and those whose language is unclear.

    Null id: kept by its text. Repeated rows: each is judged. No row with a language to learn from: all are dropped.
    """
    out = unused(docs, "language")
    found = langid.identify(docs, langid.fit(langid.training(docs)), out=out)
    return found.where((F.col(f"{out}.lang_pred") != "und") & (F.col(f"{out}.score") >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates, once.

    Null id: kept, every row. Repeated rows (same id and text): one stays, the least of the others' hash of all columns.
    Rows of one id with different texts stay or go together. Null or empty text: kept.
    """
    dropped = staged(minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "pipeline-dropped")
    left = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    place = unused(docs, "place")
    of_row = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
    once = left.where("doc_id IS NOT NULL").withColumn(place, F.row_number().over(of_row)).where(F.col(place) == 1).drop(place)
    return once.unionByName(left.where("doc_id IS NULL"))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item. Null id, null or empty text: kept. Repeated rows: each is judged. Empty benchmark: all stay."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind and counts characters anew. Null text: stays null, with a null count. Null id and repeated rows: as any."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, with its number. Null source: a source of its own. Null or empty text: size 0, may be taken. Repeated rows: each is a document."""
    return mixing.emit(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("mix", mix)]

#: Language identification and weak supervision fit models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
