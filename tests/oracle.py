"""Run a Spark query and its SQL twin on the same parquet tables and compare."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if isinstance(value, int):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(con, df, sql: str) -> str | None:
    """None when equal, else a short description of the first difference."""
    rel = con.sql(sql)
    want_cols, want = _rows(list(rel.columns), rel.fetchall())
    have_cols, have = _rows(df.columns, [tuple(r) for r in df.collect()])
    if want_cols != have_cols:
        return f"columns {have_cols} != {want_cols}"
    if len(want) != len(have):
        return f"rows {len(have)} != {len(want)}; e.g. {have[:2]} / {want[:2]}"
    if want != have:
        bad = [(h, w) for h, w in zip(have, want) if h != w]
        return f"{len(bad)} of {len(want)} rows differ, e.g. {have_cols}: {bad[:2]}"
    return None
