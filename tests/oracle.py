"""Compare a query with its SQL counterpart the way the driver does: by sorted columns and rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect()), key=repr)


def duck_rows(con, sql):
    rel = con.sql(sql)
    order = sorted(range(len(rel.columns)), key=lambda i: rel.columns[i])
    names = [rel.columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rel.fetchall()), key=repr)


def difference(df, con, sql) -> str | None:
    """None if both sides agree, else what differs."""
    return compare(spark_rows(df), duck_rows(con, sql))


def compare(left, right) -> str | None:
    (names, mine), (their_names, theirs) = left, right
    if names != their_names:
        return f"columns {names} / {their_names}"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows / {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]}"
    return None
