"""Keyed state of streams and tables: a cache that returns stored values, a queue of unread reports, a rate limiter.

All three are processors of transformWithState, so they need the RocksDB state store (``state_conf``). A key's rows are taken in
order of time: of a stream those of a micro-batch are sorted in its task, a table comes sorted, so that a key of any number of
rows goes by one by one. State lies in the stream's checkpoint and goes on after a restart; what a
key's state holds is bounded by its own rules.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_conf(spark: SparkSession) -> None:
    """Let the session keep state in RocksDB, which state with a time to live needs; over a table it also needs the session's stream manager, which starts when it is asked for.

    State with a time to live always asks for one more micro-batch. A stream that is to end (``availableNow``) needs
    spark.sql.streaming.noDataMicroBatches.enabled off when it is started.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    _ = spark.streams.active


class _InOrder(StatefulProcessor):
    """A processor whose rows come by time, then id. sorted_: they already do."""

    def __init__(self, sorted_: bool):
        self.sorted_ = sorted_

    def in_order(self, rows: Iterator[Row]) -> Iterator[Row]:
        return rows if self.sorted_ else iter(sorted(rows, key=lambda r: (r["t"], r["id"])))

    def close(self) -> None:
        pass


def _applied(df: DataFrame, processor: type[_InOrder], options: tuple, schema: str, ttl: bool) -> DataFrame:
    state_conf(df.sparkSession)
    rows = df if df.isStreaming else df.repartition("key").sortWithinPartitions("key", "t", "id")
    return rows.groupBy("key").transformWithState(processor(*options, sorted_=not df.isStreaming), schema, "Append", "ProcessingTime" if ttl else "None")


class CachedValues(_InOrder):
    """Rows (key, t, id, value): the value that was stored for the key less than ttl seconds before, or else the row's own, which is stored."""

    def __init__(self, ttl: float, sorted_: bool):
        super().__init__(sorted_)
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        # the store drops an entry by its own clock, which may run slower or faster than the times of rows: what counts is the check below
        self.entry = handle.getValueState("entry", "value string, t double", ttlDurationMs=int(2000 * self.ttl))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        found = self.entry.get() if self.entry.exists() else None
        stored = changed = (found[0], found[1]) if found else None
        for r in self.in_order(rows):
            hit = stored is not None and r["t"] - stored[1] < self.ttl
            if not hit:
                stored = (r["value"], r["t"])
            yield Row(key=key[0], id=r["id"], hit=hit, value=stored[0])
        if stored != changed:
            self.entry.update(stored)


def cached(rows: DataFrame, key: str, time: str, id_col: str, value: str, ttl: float = 24 * 3600) -> DataFrame:
    """``(key, id, hit, value)`` of each row: a hit returns what the cache holds, a miss stores the row's value for ttl seconds.

    A null key is a key of its own, the empty text. A late row is a hit if the entry is there, even when that is younger.
    """
    given = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(time).cast("timestamp").cast("double").alias("t"), F.col(id_col).cast("long").alias("id"), F.col(value).cast("string").alias("value"))
    return _applied(given, CachedValues, (ttl,), "key string, id long, hit boolean, value string", True)


class UnreadReports(_InOrder):
    """Rows (key, t, id, kind, report) of a project: ``report`` adds one, ``ack`` removes it, ``replay`` gives out what is unread."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.unread = handle.getListState("unread", "report string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = [r[0] for r in self.unread.get()]
        reports = list(before)
        for r in self.in_order(rows):
            if r["kind"] == "report":
                reports.append(r["report"])
            elif r["kind"] == "ack":
                reports = [x for x in reports if x != r["report"]]
            elif r["kind"] == "replay":
                for nth, x in enumerate(reports):
                    yield Row(key=key[0], id=r["id"], nth=nth, report=x)
        if reports != before:
            if reports:
                self.unread.put([(x,) for x in reports])
            else:
                self.unread.clear()


def unread(rows: DataFrame, key: str, time: str, id_col: str, kind: str, report: str) -> DataFrame:
    """``(key, id, nth, report)``: for each ``replay`` of a project its reports without an ``ack``, in order of arrival; an unread report stays until it is acknowledged."""
    given = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(time).cast("timestamp").cast("double").alias("t"), F.col(id_col).cast("long").alias("id"), F.col(kind).alias("kind"), F.col(report).cast("string").alias("report"))
    return _applied(given, UnreadReports, (), "key string, id long, nth int, report string", False)


class RateLimiter(_InOrder):
    """Rows (key, t, id): whether a request passes; holds the times of one window at most. Rejected requests are not recorded."""

    def __init__(self, window_s: float, most: int, sorted_: bool):
        super().__init__(sorted_)
        self.window_s, self.most = window_s, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "t double", ttlDurationMs=int(2000 * self.window_s))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        window = deque(r[0] for r in self.times.get())
        for r in self.in_order(rows):
            while window and window[0] <= r["t"] - self.window_s:
                window.popleft()
            passes = len(window) < self.most
            if passes:
                window.append(r["t"])
            yield Row(key=key[0], id=r["id"], admitted=passes)
        if window:
            self.times.put([(t,) for t in window])
        else:
            self.times.clear()


def rate_limited(requests: DataFrame, key: str, time: str, id_col: str, window_s: float = 60, most: int = 300) -> DataFrame:
    """``(key, id, admitted)`` of the requests of a stream. State per key: at most ``most`` times, dropped two windows after its last change."""
    given = requests.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(time).cast("timestamp").cast("double").alias("t"), F.col(id_col).cast("long").alias("id"))
    return _applied(given, RateLimiter, (window_s, most), "key string, id long, admitted boolean", True)
