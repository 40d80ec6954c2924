"""Compare a registered query with its SQL counterpart in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(_cell(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, _cell(v)) for k, v in value.items())
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    return value


def rows_of(table):
    """Arrow table to (sorted column names, types, sorted rows)."""
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted((tuple(_cell(v) for v in row) for row in zip(*columns)), key=repr)
    return names, {n: str(table.schema.field(n).type) for n in names}, rows


def compare(df, con, sql: str) -> str | None:
    """None when equal, otherwise what differs."""
    got_names, got_types, got = rows_of(df.toArrow())
    want_names, want_types, want = rows_of(con.sql(sql).to_arrow_table())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"row count {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"first difference: {a} != {b}"
    loose = {n: (got_types[n], want_types[n]) for n in got_names
             if got_types[n].replace("large_", "") != want_types[n].replace("large_", "")}
    return f"TYPES {loose}" if loose else None
