"""Filters built from optional parameters, pages, and lookups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(or_, conditions, F.lit(False))


def equal_where_given(df: DataFrame, **values) -> DataFrame:
    """Equality on each column whose value is given; None means not given."""
    return df.filter(all_of(F.col(k) == v for k, v in values.items() if v is not None))


def in_where_given(df: DataFrame, **lists: Sequence | None) -> DataFrame:
    """OR inside a parameter, AND across parameters; an empty list doesn't filter."""
    return df.filter(all_of(F.col(k).isin(list(v)) for k, v in lists.items() if v))


def enum_where_known(df: DataFrame, column: str, value: str | None, known: Sequence[str]) -> DataFrame:
    """Equality if the value is one of the known ones; an unknown value doesn't filter."""
    return df.filter(F.col(column) == value) if value in known else df


def projected(df: DataFrame, short: Mapping[str, Column], more: Mapping[str, Column], full: Column | bool) -> DataFrame:
    """The short columns, and ``details``, a struct of the others where the full form is asked for, else null."""
    details = F.struct(*[c.alias(n) for n, c in more.items()])
    return df.select(*[c.alias(n) for n, c in short.items()], F.when(full if isinstance(full, Column) else F.lit(full), details).alias("details"))


def count_serial(df: DataFrame, by: Column, prefix: str) -> DataFrame:
    """The next number of each group: its rows and one. Numbers come again after deletes."""
    return df.groupBy(by).agg(F.concat(F.lit(prefix), (F.count("*") + 1).cast("string")).alias("next"))


def in_range(df: DataFrame, column: str, after=None, before=None) -> DataFrame:
    """A closed range; either end may be open."""
    ends = [F.col(column) >= F.lit(after)] * (after is not None) + [F.col(column) <= F.lit(before)] * (before is not None)
    return df.filter(all_of(ends))


def text_search(df: DataFrame, columns: Sequence[str], term: str) -> DataFrame:
    """Case-insensitive contains over several columns; % and _ of the term are wildcards."""
    return df.filter(any_of(F.col(c).ilike(f"%{term}%") for c in columns)) if term else df


def json_equals(df: DataFrame, column: str, wanted: Mapping[str, Sequence[str]]) -> DataFrame:
    """Text equality of JSON keys: OR over a key's values, AND over keys."""
    return df.filter(all_of(F.get_json_object(column, f"$.{k}").isin(list(map(str, v))) for k, v in wanted.items() if v))


def json_array_has(df: DataFrame, column: str, key: str, values: Sequence[str], schema: str) -> DataFrame:
    """Rows whose JSON array of objects holds one with the key at one of the values."""
    items = F.from_json(column, schema)
    return df.filter(F.exists(items, lambda x: x[key].isin(list(values)))) if values else df


def by_identifier(df: DataFrame, value: str, id_col: str, identifier_col: str) -> DataFrame:
    """The row with that id, or else with that identifier."""
    found = df.filter((F.col(id_col).cast("string") == value) | (F.col(identifier_col) == value))
    first = F.when(F.col(id_col).cast("string") == value, 0).otherwise(1)
    return found.orderBy(first, id_col).limit(1)


def page(df: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """A page of the rows in an order that must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_info(total: int, number: int, size: int) -> dict:
    """Pages, rows on this page and whether there are neighbours."""
    pages = ceil(total / size) if total else 0
    here = max(0, min(size, total - (number - 1) * size))
    return {"total": total, "pages": pages, "page": number, "rows": here, "next": number < pages, "previous": 1 < number <= pages + 1}


def label(column: str, labels: Mapping[str, str]) -> Column:
    """A label by value, else the value with capitals."""
    return F.coalesce(*[F.when(F.col(column) == k, v) for k, v in labels.items()], F.initcap(column))


def ranked(column: str, order: Sequence[str]) -> Column:
    """The place of a value in a fixed order, for sorting enumerations."""
    return F.coalesce(*[F.when(F.col(column) == v, i) for i, v in enumerate(order)], F.lit(len(order)))
