"""A durable job queue: one job a document, tried again after fixed delays, its state kept by the stream's checkpoint."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds until a failed job is tried again.
DELAYS = (30, 120, 300)
OUT = "doc_id long, attempt int, outcome string, error string"


class Retrying(StatefulProcessor):
    """Runs a document's job when it comes and, while it fails, after each delay; then gives up."""

    def __init__(self, work: Callable[[int, str, int], None], delays: tuple[float, ...]):
        self.work, self.delays = work, delays

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "attempt int, payload string")

    def _run(self, doc_id: int, attempt: int, payload: str, now: int) -> pd.DataFrame:
        error, outcome = None, "succeeded"
        try:
            self.work(doc_id, payload, attempt)
        except Exception as e:  # any failure of a job is a reason to try again
            error, outcome = str(e), "retry" if attempt <= len(self.delays) else "failed"
        if outcome == "retry":
            self.waiting.update((attempt, payload))
            self.handle.registerTimer(now + int(self.delays[attempt - 1] * 1000))
        else:
            self.waiting.clear()
        return pd.DataFrame({"doc_id": [doc_id], "attempt": [attempt], "outcome": [outcome], "error": [error]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """A document has one job: what comes while its job waits, or beside it, is dropped."""
        payloads = [p for frame in rows for p in frame["payload"]]
        if payloads and not self.waiting.exists():
            yield self._run(key[0], 1, min(payloads, key=lambda p: (p is None, p or "")), timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waiting.exists():
            attempt, payload = self.waiting.get()
            yield self._run(key[0], attempt + 1, payload, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def processed(jobs: DataFrame, work: Callable[[int, str, int], None], delays: tuple[float, ...] = DELAYS) -> DataFrame:
    """A stream of jobs (doc_id, payload) as a stream of attempts: doc_id, attempt, outcome (succeeded, retry, failed), error.

    ``work(doc_id, payload, attempt)`` raises to fail; it may run again after a restart, so it must bear that. Attempts and
    their timers are state of the stream: a query that starts again from its checkpoint takes them up. Needs RocksDB as
    state store. A stream that starts again runs no batch, and so no timer, before a source has something new; a source
    that ticks once a second and gives no rows sees to that.
    """
    kinds = dict(jobs.dtypes)
    ticks = jobs.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0")
    beside = ticks.select(*[F.lit(None).cast(kinds[c]).alias(c) for c in ("doc_id", "payload")])
    return jobs.select("doc_id", "payload").unionByName(beside).groupBy("doc_id").transformWithStateInPandas(statefulProcessor=Retrying(work, tuple(delays)), outputStructType=OUT, outputMode="append", timeMode="processingTime")
