"""Prepaid credits: balances, daily use, and the gate that refuses what the balance or the daily cap doesn't cover."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def balances(ledger: DataFrame) -> DataFrame:
    """Sum of signed amounts by organization."""
    return ledger.groupBy("org_id").agg(F.sum(F.col("amount").cast("bigint")).alias("balance"))


def consumed(ledger: DataFrame, day: Column) -> DataFrame:
    """What each organization consumed since the start of ``day``."""
    used = F.when((F.col("type") == "Consume") & (F.col("ts") >= day), -F.col("amount").cast("bigint")).otherwise(F.lit(0))
    return ledger.groupBy("org_id").agg(F.sum(used).alias("consumed_today"))


def free_documents(ledger: DataFrame, day: Column, cap: int) -> DataFrame:
    """Free documents of the day and whether they exceed the cap."""
    n = F.count_if((F.col("type") == "Consume") & (F.col("amount") == 0) & (F.col("ts") >= day))
    return ledger.groupBy("org_id").agg(n.alias("free_today")).withColumn("over_cap", F.col("free_today") > cap)


def gate(requests: DataFrame, daily_cap: int = 0) -> DataFrame:
    """Requests (org_id, seq, ts, type, amount >= 0) in order of (ts, seq), with ``accepted`` and the balance after each.

    Top-ups and refunds always count. A consumption counts if the balance covers it and, with a cap, the
    day's consumption stays within it; a refused one changes nothing. The state depends on every earlier
    decision, so an organization's requests pass one task in order, and only its state is carried from
    batch to batch: memory doesn't grow with an organization.
    """
    org = requests.schema["org_id"].dataType
    amount, day = F.col("amount").cast("bigint").alias("amount"), F.unix_date(F.to_date("ts")).alias("day")
    ordered = requests.select("org_id", "ts", F.col("seq").cast("bigint").alias("seq"), "type", amount, day).repartition("org_id").sortWithinPartitions("org_id", "ts", "seq", "type", "amount")
    rows = ordered.select("org_id", "seq", "type", "amount", "day")
    return rows.mapInArrow(_fold(daily_cap), T.StructType([T.StructField("org_id", org), *T.StructType.fromDDL("seq bigint, accepted boolean, balance bigint").fields]))


def _fold(daily_cap: int):
    """Decides rows that come sorted by organization and time; nulls count as in SQL."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, balance, used, today = object(), 0, 0, None
        for b in batches:
            accepted, after = [], []
            for org, kind, amount, day in zip(*(b.column(c).to_pylist() for c in ("org_id", "type", "amount", "day"))):
                if org != last:
                    last, balance, used, today = org, 0, 0, None
                used = used if day is not None and day == today else 0
                today = day
                unknown = balance is None or amount is None
                within = daily_cap <= 0 or (None if amount is None else used + amount <= daily_cap)
                ok = False if within is False or (not unknown and balance < amount) else None if unknown or within is None else True
                if kind == "Consume":
                    if ok is not False:
                        balance = None if unknown else balance - amount
                    used += amount if ok else 0
                else:
                    ok = True if kind is not None else ok or None
                    balance = None if unknown else balance + amount
                accepted.append(ok)
                after.append(balance)
            yield pa.RecordBatch.from_arrays([b.column("org_id"), b.column("seq"), pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())], names=["org_id", "seq", "accepted", "balance"])

    return run


def refunds(documents: DataFrame) -> DataFrame:
    """Refund rows (doc_id, charged, status, actual): all that was charged for a failure, the difference for a cheaper path."""
    back = F.when(F.col("status") == "Failed", F.col("charged")).otherwise(F.greatest(F.col("charged") - F.col("actual"), F.lit(0)))
    return documents.select("doc_id", F.lit("Refund").alias("type"), back.alias("amount")).where("amount > 0")


def page(ledger: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of transactions, newest first; at least page 1, sizes from 1 to 100."""
    number, size = max(1, number), min(100, max(1, size))
    return ledger.orderBy(F.col("ts").desc(), F.col("seq").desc()).offset((number - 1) * size).limit(size)
