"""Streams: rules on a stream, windows, first events; and the rate limiter over a table."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator
from time import monotonic

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.operators.diagnosis import classify
from tessera.sources.files import rule_tuples

WINDOW_S, MAX_REQUESTS = 60, 300


def rate_limited_batch(requests: DataFrame, key: str, time: str, id_col: str, window_s: float = WINDOW_S, most: int = MAX_REQUESTS) -> DataFrame:
    """``(key, id, admitted)`` of a table of requests, by the rule of ``state.rate_limited``.

    Requests come sorted by key and time; a task goes through them one by one and holds the times of one window of one key, so a
    key with any number of requests needs no more memory than a window of it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, window = None, deque()
        for batch in batches:
            passed = []
            for k, t in zip(batch["key"], batch["t"], strict=True):
                if k != now:
                    now, window = k, deque()
                while window and window[0] <= t - window_s:
                    window.popleft()
                passed.append(len(window) < most)
                if passed[-1]:
                    window.append(t)
            yield pd.DataFrame({"key": batch["key"], "id": batch["id"], "admitted": passed})

    rows = requests.select(F.col(key).cast("string").alias("key"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"), F.col(id_col).cast("long").alias("id"))
    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInPandas(run, "key string, id long, admitted boolean")


def classified(logs: DataFrame) -> DataFrame:
    """Findings of a stream of logs; the rules are a CASE expression, so no state is kept."""
    return classify(logs)


class RuleCache:
    """Rules of a file, read again when they are older than so many seconds; for a stream's ``foreachBatch``."""

    def __init__(self, spark: SparkSession, path: str, seconds: float = 60):
        self.spark, self.path, self.seconds = spark, path, seconds
        self._read_at, self._rules = -math.inf, []

    def rules(self) -> list[tuple]:
        if monotonic() - self._read_at >= self.seconds:
            self._rules, self._read_at = rule_tuples(self.spark, self.path), monotonic()
        return self._rules


def counts_per_window(events: DataFrame, time: str, by: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``(start, by, n)`` per tumbling window, for a stream or a table; late rows beyond the watermark are left out of a stream."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(F.window("_t", window).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def first_in_ttl(events: DataFrame, keys: list[str], time: str, ttl: str = "24 hours") -> DataFrame:
    """The first event of each key within a time to live, as a cache would let through."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", ttl)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_t")
