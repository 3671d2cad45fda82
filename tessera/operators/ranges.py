"""Running sums and last values over all partitions: rows are sorted by ranges, so that no group has to fit a task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.operators.rounds import settled


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of value over the rows of equal keys up to this one and with it, in an order that leaves no ties.

    A group that spans several ranges gets the sums of its earlier ranges added, of which there is a row for
    each range at most; a range is a task, whatever the sizes of groups. Keys mustn't be null.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_v", value).repartitionByRange(tasks, *keys, *order)
    rows = settled(rows.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = rows.groupBy("_part", *keys).agg(F.sum("_v").alias("_t"))
    spans = totals.groupBy(*keys).agg(F.collect_list(F.struct("_part", "_t")).alias("_p")).filter(F.size("_p") > 1)  # of a group that spans ranges, a pair each
    first = spans.select(*keys, F.explode("_p").alias("_r"), "_p").select(*keys, F.col("_r._part").alias("_part"), _before("_p", "_r").alias("_b"))
    summed = rows.withColumn("_s", F.sum("_v").over(inside)).join(F.broadcast(first), ["_part", *keys], "left")
    return summed.select(*df.columns, (F.col("_s") + F.coalesce("_b", F.lit(0))).alias(name))


def _before(parts: str, own: str) -> Column:
    earlier = F.filter(parts, lambda p: p["_part"] < F.col(own)["_part"])
    return F.aggregate(earlier, F.lit(0).cast("long"), lambda a, p: a + p["_t"])


def last_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the last value that isn't null of the rows of equal keys before this one, in an order that leaves no ties.

    A group that spans several ranges gets the last value of its earlier ranges, of which there is a row for each range at most. Keys mustn't be null.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_v", value).repartitionByRange(tasks, *keys, *order)
    rows = settled(rows.withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("_part", *keys).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_t"))
    spans = ends.groupBy(*keys).agg(F.collect_list(F.struct("_part", "_t")).alias("_p")).filter(F.size("_p") > 1)  # of a group that spans ranges, a pair each
    first = spans.select(*keys, F.explode("_p").alias("_r"), "_p").select(*keys, F.col("_r._part").alias("_part"), _last_of("_p", "_r").alias("_b"))
    found = rows.withColumn("_l", F.last("_v", ignorenulls=True).over(inside)).join(F.broadcast(first), ["_part", *keys], "left")
    return found.select(*df.columns, F.coalesce("_l", "_b").alias(name))


def _last_of(parts: str, own: str) -> Column:
    """The value of the last earlier range that has one."""
    earlier = F.array_sort(F.filter(parts, lambda p: (p["_part"] < F.col(own)["_part"]) & p["_t"].isNotNull()), lambda a, b: a["_part"] - b["_part"])
    return F.when(F.size(earlier) > 0, F.element_at(earlier, -1)["_t"])
