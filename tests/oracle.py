"""Side-by-side comparison of registered queries with DuckDB."""

from __future__ import annotations

import math
import os
from decimal import Decimal

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canon(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    rel = con.execute(sql)
    dcols = [c[0] for c in rel.description]
    want = rows_of(dcols, rel.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(dcols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(dcols)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}; {got[:2]} vs {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} differ: spark {bad[0][0]} duck {bad[0][1]}" if bad else None


def folder(sf: str = "0.01") -> str:
    return os.environ.get("TEST_SF_DIR", f"/root/testdata/sf{sf}")
