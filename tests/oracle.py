"""Rows of a query and of its SQL, in a form that can be compared."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np


def database(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}{'/*' if os.path.isdir(f) else ''}')")
    return db


def normal(v):
    if v is None or str(v) in ("nan", "NaT", "<NA>"):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, int, np.integer, np.floating)):
        return float(f"{float(v):.9g}")
    return str(v)


def rows(frame) -> list[str]:
    columns = sorted(frame.columns)
    return sorted(str(tuple(map(normal, r))) for r in frame[columns].itertuples(index=False, name=None))
