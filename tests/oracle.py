"""Compare a registered query with its SQL, run by DuckDB on the same Parquet files."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, int):
        return v
    return v


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_value(row[i]) for i in order) for row in rows]
    return sorted(out, key=lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row))


def compare(df, sql: str, folder: str) -> list[str]:
    """Differences as text; empty when equal."""
    rows = [tuple(x) for x in df.collect()]
    names = df.columns
    cur = connect(folder).execute(sql)
    want_names = [d[0] for d in cur.description]
    want = cur.fetchall()
    out = []
    if sorted(names) != sorted(want_names):
        return [f"columns {sorted(names)} != {sorted(want_names)}"]
    a, b = _sorted(rows, names), _sorted(want, want_names)
    if len(a) != len(b):
        out.append(f"rows {len(a)} != {len(b)}")
    kinds = {n: f.dataType.simpleString() for n, f in zip(names, df.schema.fields)}
    for i, n in enumerate(sorted(names)):
        ours = {type(x[i]) for x in a} - {type(None)}
        theirs = {type(x[i]) for x in b} - {type(None)}
        if ours != theirs and ours and theirs:
            out.append(f"type of {n}: {kinds[n]} {ours} != {theirs}")
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        out.append(f"{len(diff)} rows differ, columns {sorted(names)}, first: {diff[0]}")
    return out
