"""A cache of model responses by text and model: a Parquet table in buckets of the key, of which a run rewrites those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.textnorm import squeeze, text_hash

#: Fixed value: characters of a text that a model is given.
MOST = 20_000
SCHEMA = "text_hash string, model string, response_json string, created_at timestamp, bucket int"
BUCKETS = 64


def asked(documents: DataFrame, model: str, most: int = MOST) -> DataFrame:
    """Documents (doc_id, text) as requests: the hash of the whole squeezed text, the model, and what the model is given of it."""
    given = F.substring(squeeze(F.col("text")), 1, most)
    return documents.select("doc_id", text_hash(F.col("text")).alias("text_hash"), F.lit(model).alias("model"), given.alias("given"))


def newest(entries: DataFrame) -> DataFrame:
    """The newest response of each text and model; of equal times the greatest."""
    best = F.max(F.struct("created_at", "response_json"))
    return entries.groupBy("text_hash", "model").agg(best.alias("b")).select("text_hash", "model", "b.response_json", "b.created_at")


def looked_up(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Requests with ``response_json`` of the newest entry, null where none is, and ``hit``."""
    found = newest(entries).drop("created_at").withColumn("hit", F.lit(True))
    return requests.join(found, ["text_hash", "model"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def remember(responses: DataFrame, path: str, *, buckets: int = BUCKETS, staging: str | None = None) -> None:
    """Merges responses (text_hash, model, response_json, created_at) into the table at ``path``; the newest of a key stays.

    Only buckets with new keys are read and written again: merged beside the table first, as a table can't be written over
    while it is read, then moved over it bucket by bucket. Merging the same responses twice changes nothing, so a run
    that broke off is simply repeated. The bucket is of the key's hash, so no key is split and no bucket is hot.
    """
    spark = responses.sparkSession
    new = responses.withColumn("bucket", F.pmod(F.xxhash64("text_hash", "model"), F.lit(buckets)).cast("int"))
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
    if not touched:
        return
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(root)
    every = new.unionByName(read(spark, path).where(F.col("bucket").isin(touched))) if known else new
    merged = newest(every).withColumn("bucket", F.pmod(F.xxhash64("text_hash", "model"), F.lit(buckets)).cast("int"))
    beside = staging or f"{path.rstrip('/')}_merging"
    merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(beside)
    back = spark.read.schema(SCHEMA).parquet(beside)
    back.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def remember_stream(responses: DataFrame, path: str, checkpoint: str, *, buckets: int = BUCKETS):
    """A stream of responses merged batch by batch; the checkpoint makes a rerun take up where it ended."""
    return responses.writeStream.foreachBatch(lambda batch, _: remember(batch, path, buckets=buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
