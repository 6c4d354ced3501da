"""Structured Streaming forms of the queue, the limiter, the ledger and the insert-if-absent cache."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_OUT = "org_id long, seq long, accepted boolean, balance long"


def ingest(spark: SparkSession, path: str, schema: str, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs ``work`` on what is new under a path and stops; the checkpoint makes a rerun take up where it ended."""
    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_window(events: DataFrame, limit: int = 10, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests of each user in fixed windows, and whether they exceed the limit; late events count up to the watermark."""
    if events.isStreaming:
        events = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", width).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "user_id", "n", (F.col("n") > limit).alias("limited"))


def first_seen(rows: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key; on a stream, keys are remembered as long as the watermark asks."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if rows.isStreaming else rows.dropDuplicates(keys)


def gated(requests: DataFrame, daily_cap: int = 0) -> DataFrame:
    """The credit gate over a stream of requests (org_id, seq, ts, type, amount >= 0), its state kept by organization.

    A key's rows of one micro-batch come in several chunks; they are put in order of ts and seq together, so memory is
    bounded by what a micro-batch brings for a key. Requests that come in a later micro-batch are judged later.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        balance, used, day = state.get if state.exists else (0, 0, "")
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for seq, ts, kind, amount in zip(rows["seq"], rows["ts"], rows["type"], rows["amount"]):
            today, amount = str(ts)[:10], int(amount)
            used = used if today == day else 0
            day = today
            if kind == "Consume":
                ok = balance >= amount and (daily_cap <= 0 or used + amount <= daily_cap)
                balance, used = (balance - amount, used + amount) if ok else (balance, used)
            else:
                ok, balance = True, balance + amount
            out.append((key[0], int(seq), ok, balance))
        state.update((balance, used, day))
        yield pd.DataFrame(out, columns=["org_id", "seq", "accepted", "balance"])

    return requests.groupBy("org_id").applyInPandasWithState(step, LEDGER_OUT, "balance long, used long, day string", "append", "NoTimeout")
