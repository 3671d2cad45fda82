"""Conditional aggregates, rates with fallbacks, pivots with fixed buckets, serials, modes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def rate(part: Column, whole: Column, digits: int = 1) -> Column:
    """Per cent; 0 without a whole."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(0.0)


def pass_rate(passed: Column, total: Column, tested: Column, endpoints: Column, digits: int = 1) -> Column:
    """From executions if there are any, else from the share of endpoints tested, else 0."""
    return F.when(total > 0, rate(passed, total, digits)).otherwise(rate(tested, endpoints, digits))


def status_counts(df: DataFrame, keys: Sequence[str], column: str, values: Sequence[str]) -> DataFrame:
    """A counter per value in one pass, zero buckets kept, and their sum as total."""
    counts = [F.count_if(F.col(column) == v).alias(v) for v in values]
    return df.groupBy(*keys).agg(*counts).withColumn("total", sum(F.col(v) for v in values))


def histogram(df: DataFrame, column: str, buckets: Sequence[str], rest: str) -> DataFrame:
    """One row with a count per fixed bucket; other values, and null, count as rest."""
    bucket = F.when(F.col(column).isin(list(buckets)), F.col(column)).otherwise(rest)
    return df.select(bucket.alias("b")).agg(*[F.count_if(F.col("b") == b).alias(b) for b in dict.fromkeys([*buckets, rest])])


def child_sums(parents: DataFrame, key: str, children: DataFrame, child_key: str, **sums: Column) -> DataFrame:
    """Every parent with its children's count and sums; 0 without children. Children are summed before the join."""
    own = children.groupBy(F.col(child_key).alias("_k")).agg(F.count("*").alias("children"), *[F.sum(c).alias(n) for n, c in sums.items()])
    joined = parents.join(own, F.col(key) == F.col("_k"), "left").drop("_k")
    return joined.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("children", *sums)})


def next_serial(df: DataFrame, column: str, prefix: str, floor: int = 1000) -> DataFrame:
    """One more than the largest number behind the prefix, and than floor."""
    number = F.regexp_extract(column, f"^{prefix}(\\d+)$", 1)
    top = F.max(F.when(number != "", number.cast("long")))
    return df.agg((F.greatest(F.coalesce(top, F.lit(floor)), F.lit(floor)) + 1).alias("next_serial"))


def mode(df: DataFrame, key: str, column: str) -> DataFrame:
    """The commonest value of each key; ties go to the least value."""
    counts = df.groupBy(key, column).agg(F.count("*").alias("n"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col(column).alias("v"))).alias("b"))
    return best.select(key, F.col("b.v").alias(column), (-F.col("b.o")).alias("n"))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in an order, by a window that Spark limits before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def renumbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Dense numbers from 1 in each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
