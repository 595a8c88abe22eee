"""Side-by-side comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> str:
    """'' if both sides agree, else what differs."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    want = rows_of(names, got.fetchall())
    have = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} for {sorted(names)}"
    if have != want:
        odd = next(((a, b) for a, b in zip(have, want) if a != b), None)
        return f"{len(have)} rows for {len(want)}; first difference {odd}"
    return ""
