"""Runs a query and its oracle SQL on the same tables and compares them."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def oracle_rows(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return names, [tuple(r) for r in cur.fetchall()]


def _cell(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float) and math.isnan(v):
        return None
    return float(v) + 0.0 if isinstance(v, (int, float)) else (float(v) if hasattr(v, "as_tuple") else v)


def normal(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    want = normal(*oracle_rows(sql, sf_dir))
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}: {got[1][:2]} {want[1][:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    return f"{len(bad)} of {len(got[1])} rows differ: {bad[:3]}" if bad else None
