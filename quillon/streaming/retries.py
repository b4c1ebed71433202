"""Requests answered once each, with what is known of every key kept as state of the stream.

For each key the state holds whether it is done, how often it was tried, the last error, the request, and a timer for the next try.
A first request is tried in the batch it arrives in; a failure sets the timer, and when it is due a later batch tries again; after
``attempts`` failures the key goes to the dead letters with its last error. All of it outlives a restart, as it is part of the
checkpoint. A batch writes its results under its number and commits its state afterwards, so a crash between the two repeats the
batch over what it wrote: each key is there once.

A request for a key that is known is not tried again. Null keys are one key. Times are those of the cluster's clock.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Where a key stands: tried and waiting, answered, given up.
WAITING, DONE, DEAD = "waiting", "done", "dead"
OUT = "output string, error string, attempts int, state string"


class Retrying(StatefulProcessor):
    """``ask``: a factory of a function from a request to an answer, which raises where there is none."""

    def __init__(self, key: str, request: str, ask: Callable[[], Callable[[str], str]], attempts: int, delay_ms: int):
        self.key, self.request, self.make, self.attempts, self.delay_ms, self.ask = key, request, ask, attempts, delay_ms, None

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "state string, attempts int, error string, request string")

    def _try(self, key, request, tried: int, now: int) -> pd.DataFrame:
        self.ask = self.ask or self.make()
        try:
            answer, error, state = self.ask(request), None, DONE
        except Exception as e:  # noqa: BLE001  a request's failure is part of its state
            answer, error = None, f"{type(e).__name__}: {e}"
            state = WAITING if tried + 1 < self.attempts else DEAD
        if state == WAITING:
            self.handle.registerTimer(now + self.delay_ms)
        self.known.update((state, tried + 1, error, request))
        return pd.DataFrame({self.key: [key[0]], "output": [answer], "error": [error], "attempts": [tried + 1], "state": [state]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = next((pdf[self.request].iloc[0] for pdf in rows if len(pdf)), None)
        for _ in rows:
            pass
        if not self.known.exists():
            yield self._try(key, first, 0, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, tried, _, request = self.known.get()
        if state == WAITING:
            yield self._try(key, request, tried, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def answer_stream(
    source: DataFrame, key: str, request: str, ask: Callable[[], Callable[[str], str]], out: str, checkpoint: str, attempts: int = 3, delay_ms: int = 60_000, **trigger
) -> StreamingQuery:
    """Outcomes under ``out``, a folder a batch and in it one a state.

    ``trigger``: as for a stream's trigger. The default runs one batch, of all requests that are there and all tries that are due, and
    ends; with ``processingTime`` the stream goes on. ``availableNow`` would never end, as there may always be a try that falls due.
    """
    if trigger.get("availableNow"):
        raise ValueError("a stream with timers doesn't end by itself; use once or processingTime")
    spark = source.sparkSession
    spark.conf.set(PROVIDER_CONF, PROVIDER)
    kind = source.schema[key].dataType.simpleString()
    slim = source.select(key, F.col(request).cast("string").alias(request))
    tried = slim.groupBy(key).transformWithStateInPandas(Retrying(key, request, ask, attempts, delay_ms), f"{key} {kind}, {OUT}", "Update", "ProcessingTime")

    def batch(df: DataFrame, number: int) -> None:
        # one job: what becomes of a key is the folder it goes to
        df.write.mode("overwrite").partitionBy("state").parquet(f"{out}/batch={number}")

    return tried.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"once": True})).start()


def outcomes(spark: SparkSession, out: str, state: str = DONE) -> DataFrame:
    """What has been written of a state: answered keys, given-up ones, or every failed try that was to be repeated."""
    return spark.read.parquet(out).where(F.col("state") == state).drop("batch")
