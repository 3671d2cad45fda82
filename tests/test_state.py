import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import ttl
from tessera.streaming import limits, state

START = 1_700_000_000


def frame_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds(F.col("t") + START))


def streamed(spark, tmp_path, frame, parts, make):
    """Rows in files of their own, a stream started again for each, from its checkpoint."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # state with a time to live would go on asking for batches
    try:
        for condition in parts:
            frame.filter(condition).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = make(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    return spark.read.parquet(f"{tmp_path}/out").collect()


def by_hand(rows, seconds):
    """(id, hit, value) of a cache, a row at a time."""
    stored, out = {}, []
    for id_, key, t, value in sorted(rows, key=lambda r: (r[2], r[0])):
        key = key or ""
        if key not in stored or t - stored[key][1] >= seconds:
            stored[key] = (value, t)
            out.append((id_, False, value))
        else:
            out.append((id_, True, stored[key][0]))
    return sorted(out)


def cache_rows(n=150):
    rng = random.Random(3)
    return [(i, rng.choice(["hot", "hot", "a", "b", None]), float(rng.randrange(400)), rng.choice([f"v{i}", None])) for i in range(n)]


CACHE = "id long, key string, t double, value string"


@pytest.mark.parametrize("make", [ttl.cached, state.cached])
def test_cache_over_a_table(spark, make):
    rows = cache_rows()
    got = make(frame_of(spark, rows, CACHE).repartition(3), "key", "at", "id", "value", 50).collect()
    assert sorted((r.id, r.hit, r.value) for r in got) == by_hand(rows, 50)
    assert make(frame_of(spark, rows, CACHE).limit(0), "key", "at", "id", "value", 50).count() == 0


def test_cache_of_a_stream_expires_and_goes_on_after_a_restart(spark, tmp_path):
    rows = cache_rows(40)
    got = streamed(spark, tmp_path, frame_of(spark, rows, CACHE), ["t < 150", "t >= 150 and t < 280", "t >= 280"], lambda s: state.cached(s, "key", "at", "id", "value", 50))
    assert sorted((r.id, r.hit, r.value) for r in got) == by_hand(rows, 50)


def test_a_late_row_gets_the_entry(spark, tmp_path):
    rows = [(1, "k", 100.0, "first"), (2, "k", 90.0, "late"), (3, "k", 149.0, "x"), (4, "k", 150.0, "new")]
    got = streamed(spark, tmp_path, frame_of(spark, rows, CACHE), ["id = 1", "id = 2", "id > 2"], lambda s: state.cached(s, "key", "at", "id", "value", 50))
    assert {r.id: (r.hit, r.value) for r in got} == {1: (False, "first"), 2: (True, "first"), 3: (True, "first"), 4: (False, "new")}


def test_unread_reports_until_they_are_acknowledged(spark, tmp_path):
    rows = [(1, "p", 1.0, "report", "a"), (2, "p", 2.0, "report", "b"), (3, "q", 2.5, "report", "c"), (4, "p", 3.0, "replay", None), (5, "p", 4.0, "ack", "a"), (6, "p", 5.0, "replay", None)]
    rows += [(7, "p", 6.0, "report", "d"), (8, "p", 7.0, "replay", None), (9, "q", 8.0, "ack", "c"), (10, "q", 9.0, "replay", None), (11, "q", 10.0, "ack", "none"), (12, "p", 11.0, "replay", None)]
    schema = "id long, key string, t double, kind string, report string"
    want = {(4, 0, "a"), (4, 1, "b"), (6, 0, "b"), (8, 0, "b"), (8, 1, "d"), (12, 0, "b"), (12, 1, "d")}
    make = lambda df: state.unread(df, "key", "at", "id", "kind", "report")
    frame = frame_of(spark, rows, schema)
    assert {(r.id, r.nth, r.report) for r in make(frame.repartition(3)).collect()} == want
    assert {(r.id, r.nth, r.report) for r in streamed(spark, tmp_path, frame, ["id < 5", "id >= 5 and id < 8", "id >= 8"], make)} == want


def test_rate_limiter_of_streams_and_tables(spark, tmp_path):
    times = [0, 1, 2, 3, 61, 61.5, 62]
    rows = [(i, "k", float(t)) for i, t in enumerate(times)] + [(99, "m", 0.0)]
    frame = frame_of(spark, rows, "id long, key string, t double")
    want = {0: True, 1: True, 2: True, 3: False, 4: True, 5: True, 6: True, 99: True}
    for limited in (state.rate_limited, limits.rate_limited_batch):
        assert {r.id: r.admitted for r in limited(frame.repartition(2), "key", "at", "id", 60, 3).collect()} == want
    got = streamed(spark, tmp_path, frame, ["t < 2.5", "t >= 2.5"], lambda s: state.rate_limited(s, "key", "at", "id", 60, 3))
    assert {r.id: r.admitted for r in got} == want
