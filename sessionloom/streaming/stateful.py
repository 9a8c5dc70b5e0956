"""Streams with event time and keyed state: health by time window, deltas behind a session's mark, and retry latches.

Each starts a query that takes what there is, in micro-batches, and ends. State stands in the RocksDB state store, whose
checkpoints are in the shared folder, so a lost executor costs no rows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """A query keeps the state store that is set when it starts."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def _appended(df: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    with _rocksdb(df.sparkSession):
        return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def health_stream(log: DataFrame, target: str, checkpoint: str, every: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Appends (start, kind, n) of every time window once the watermark, ``late`` behind the newest row, has passed its end.

    A row whose window was over before its micro-batch is dropped; rows without a time or kind count nowhere. State
    holds the open windows only.
    """
    stamped = log.filter("ts is not null and kind is not null").withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    counted = stamped.groupBy(F.window("at", every).alias("w"), "kind").agg(F.count("*").alias("n"))
    return _appended(counted.select(F.unix_millis("w.start").alias("start"), "kind", "n"), target, checkpoint)


class _Deltas(StatefulProcessor):
    """The last entry considered of each session."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mark = handle.getValueState("mark", "entry_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        mark = self.mark.get()
        entries = sorted((r["pos"], r["entry_id"]) for r in rows)
        known = max((pos for pos, entry in entries if mark is not None and entry == mark[0]), default=None)
        self.mark.update((entries[-1][1],))
        for pos, entry in entries:
            if known is None or pos > known:
                yield Row(session_id=key[0], entry_id=entry, pos=pos, reset=known is None)


def delta_stream(entries: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends (session_id, entry_id, pos, reset): of each micro-batch the entries behind the last one considered of their session.

    The mark moves to a batch's last entry even where nothing is new. A batch that doesn't hold the mark is taken whole,
    with ``reset``. State is one id a session; sessions are short, so rows pass as they are, without a frame for each session.
    """
    slim = entries.select("session_id", "entry_id", "pos").groupBy("session_id")
    found = slim.transformWithState(_Deltas(), "session_id string, entry_id string, pos long, reset boolean", "Append", "None")
    return _appended(found, target, checkpoint)


class _Latch(StatefulProcessor):
    """Attempts made at a boundary, the time of the last, and a timer for when the next may follow."""

    def __init__(self, most: int, wait_ms: int):
        self.most, self.wait_ms = most, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("latch", "attempts int, last_ts long, opens long")

    def _row(self, key, ts: int, what: str, attempts: int) -> tuple:
        return (*key, ts, what, attempts)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, last, opens = self.state.get() if self.state.exists() else (0, 0, 0)
        timer, out = opens, []
        for ts in sorted(pd.concat(list(rows))["ts"].tolist()):
            if attempts >= self.most and ts - last < self.wait_ms:
                out.append(self._row(key, ts, "refused", attempts))
                continue
            if opens:
                out.append(self._row(key, opens, "opened", attempts))
            attempts, last = attempts + 1, ts
            opens = ts + self.wait_ms if attempts >= self.most else 0
            out.append(self._row(key, ts, "attempt", attempts))
        if opens != timer:
            if timer:
                self.handle.deleteTimer(timer)
            if opens:
                self.handle.registerTimer(opens)
        self.state.update((attempts, last, opens))
        yield pd.DataFrame(out, columns=["session", "boundary", "ts", "what", "attempts"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        attempts, last, opens = self.state.get()
        self.state.update((attempts, last, 0))
        yield pd.DataFrame([self._row(key, opens, "opened", attempts)], columns=["session", "boundary", "ts", "what", "attempts"])


def latch_stream(wishes: DataFrame, target: str, checkpoint: str, most: int = 3, wait_ms: int = 600_000, late: str = "30 seconds") -> StreamingQuery:
    """Appends (session, boundary, ts, what, attempts) for rows (session, boundary, ts) that wish to try a boundary.

    ``attempt``: it is tried, the ``attempts``-th time. ``refused``: after ``most`` attempts, less than ``wait_ms`` after the last
    one. ``opened``: from this time on it may be tried again, told by an event-time timer once the watermark has passed,
    or by the next attempt. Wishes of a micro-batch count in order of time. State is one row a boundary.
    """
    stamped = wishes.select("session", "boundary", "ts", F.timestamp_millis("ts").alias("at")).withWatermark("at", late)
    found = stamped.groupBy("session", "boundary").transformWithStateInPandas(_Latch(most, wait_ms), "session string, boundary string, ts long, what string, attempts int", "Append", "EventTime")
    return _appended(found, target, checkpoint)
