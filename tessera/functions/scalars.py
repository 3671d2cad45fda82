"""Scalar functions on columns: paths, names, times."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dirname(path: Column) -> Column:
    """All of a path before its last slash; empty without one."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def last_folder(path: Column) -> Column:
    """The name of the folder that a file lies in; empty at the root."""
    return basename(dirname(path))


def slug(text: Column) -> Column:
    """Runs of signs that are no letter, digit, underscore or dash as one dash."""
    return F.regexp_replace(text, r"(?U)[^\w\-]+", "-")


def iso_time(text: Column) -> Column:
    """A time from ISO text, with Z or an offset, or in the session's zone; null where it is none."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def milliseconds(start: Column, stop: Column) -> Column:
    """Whole milliseconds from start to stop."""
    return F.floor((F.unix_micros(stop.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1000)


def range_start(period: Column, now: Column) -> Column:
    """When a relative range began: 7d, 30d or 90d before now; any other since 2020-01-01."""
    days = F.when(period == "7d", 7).when(period == "30d", 30).when(period == "90d", 90)
    return F.when(days.isNotNull(), now - F.make_interval(days=days)).otherwise(F.lit("2020-01-01").cast("timestamp_ntz"))
