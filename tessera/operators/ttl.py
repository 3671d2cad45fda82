"""A cache with a time to live over a table: what a stream's cache would have returned, without going through a key's rows one by one."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators.ranges import last_before
from tessera.operators.rounds import settled


def cached(rows: DataFrame, key: str, time: str, id_col: str, value: str, ttl: float = 24 * 3600) -> DataFrame:
    """``(key, id, hit, value)`` of each row in order of time, then id: a hit returns what was stored less than ttl seconds before, a miss stores its own value.

    Each row points to the first row that would miss if it had missed itself, the first one ttl or more later. Misses are
    what the first row of a key leads to; pointers double, so a key with n misses takes about log2(n) rounds of joins,
    whatever its number of rows. Pointers, and the last miss before a row, come from sorts by ranges, so a
    hot key is split. A null key is the empty text, as in ``streaming.state.cached``, which gives the same rows.
    """
    given = rows.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("t"), F.col(id_col).cast("long").alias("id"), F.col(value).cast("string").alias("value"))
    placed = settled(given.withColumn("place", F.monotonically_increasing_id()))
    probe = placed.select("key", (-F.col("t") - int(ttl * 1e6)).alias("back"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("nid"), "place")
    row = placed.select("key", (-F.col("t")).alias("back"), F.lit(0).alias("kind"), (-F.col("id")).alias("nid"), "place")
    led = last_before(row.union(probe), ["key"], ["back", "kind", "nid", "place"], F.when(F.col("kind") == 0, F.col("place")), "next")
    jump = settled(led.filter("kind = 1 and next is not null").select("place", "next"))
    missed = settled(placed.groupBy("key").agg(F.min(F.struct("t", "id", "place")).alias("f")).select("f.place"))
    while not jump.isEmpty():
        missed = settled(missed.union(missed.join(jump, "place").select("next")).distinct())
        jump = settled(jump.join(jump.select(F.col("place").alias("next"), F.col("next").alias("after")), "next").select("place", F.col("after").alias("next")))
    marked = placed.join(missed.withColumn("miss", F.lit(True)), "place", "left").select("key", "t", "id", "place", "value", F.coalesce("miss", F.lit(False)).alias("miss"))
    stored = last_before(marked, ["key"], ["t", "id", "place"], F.when(F.col("miss"), F.struct("value")), "entry")
    return stored.select("key", "id", (~F.col("miss")).alias("hit"), F.when(F.col("miss"), F.col("value")).otherwise(F.col("entry.value")).alias("value"))
