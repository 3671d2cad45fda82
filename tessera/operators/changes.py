"""Data modification as tables in, tables out: the caller writes the result."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def get_or_create(existing: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Existing rows and those wanted whose natural key isn't there yet, once each (the least row)."""
    new = wanted.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    rest = [c for c in wanted.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest else new.distinct()
    return existing.unionByName(once, allowMissingColumns=True)


def delete(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; null keeps."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def delete_keys(df: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def update(df: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Columns of new, where given and not null, replace those of the rows with its keys."""
    columns = [c for c in new.columns if c not in keys]
    joined = df.join(new.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns]), list(keys), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def clear_default(df: DataFrame, group: str, value, key: str, chosen, flag: str) -> DataFrame:
    """The flag true for the chosen row of a group and false for its others."""
    return df.withColumn(flag, F.when(F.col(group) == value, F.col(key) == chosen).otherwise(F.col(flag)))


def cascade(tables: Mapping[str, DataFrame], gone: DataFrame, links: Sequence[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """Tables without what hangs on rows gone; links, in order: (child, its column, parent, its column)."""
    left, lost = dict(tables), {links[0][2]: gone}
    for child, column, parent, key in links:
        keys = lost[parent].select(F.col(key).alias(column)).distinct()
        lost[child] = left[child].join(keys, column, "left_semi")
        left[child] = left[child].join(keys, column, "left_anti").select(*tables[child].columns)
    top = links[0]
    left[top[2]] = left[top[2]].join(gone.select(top[3]).distinct(), top[3], "left_anti").select(*tables[top[2]].columns)
    return left


def edit_list(column: Column, operation: str, values: Sequence[str]) -> Column:
    """ignore, replace, add or remove values of an array; the result is sorted and distinct."""
    given = F.array(*map(F.lit, values)).cast("array<string>")
    now = F.coalesce(column, F.array().cast("array<string>"))
    made = {"ignore": now, "replace": given, "add": F.array_union(now, given), "remove": F.array_except(now, given)}[operation]
    return F.array_sort(F.array_distinct(made))


def edit_map(column: Column, operation: str, values: Mapping[str, str]) -> Column:
    """ignore, replace, merge or remove the keys of a map."""
    given = F.create_map(*[F.lit(x) for kv in values.items() for x in kv]) if values else F.expr("cast(map() as map<string,string>)")
    rest = F.map_filter(column, lambda k, _: ~k.isin(list(values)))
    return {"ignore": column, "replace": given, "merge": F.map_concat(rest, given), "remove": rest}[operation]


def apply_results(cases: DataFrame, results: DataFrame, key: str, order: Sequence[str], status: str) -> tuple[DataFrame, DataFrame]:
    """Cases with the status of their last result and how many there are; results of no case, as errors."""
    last = results.groupBy(key).agg(F.max_by(status, F.struct(*order)).alias("_s"), F.count("*").alias("n_results"))
    joined = cases.join(last, key, "left").withColumn(status, F.coalesce("_s", status)).drop("_s").withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    return joined, results.join(cases.select(key), key, "left_anti")


def keep_newest(versions: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 10) -> DataFrame:
    from tessera.operators.aggregates import latest

    return latest(versions, keys, order, n)


def replace_versions(old: DataFrame, new: DataFrame, version: Sequence[str]) -> DataFrame:
    """Old rows but for the versions that new holds, and new."""
    return delete_keys(old, new, version).select(*old.columns).unionByName(new)


def union_all(frames: Sequence[DataFrame], columns: Sequence[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [f.select(*columns) for f in frames])
