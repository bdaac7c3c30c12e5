"""Compare registered queries with their SQL in DuckDB, value by value."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (round(v, 6) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def compare(spark_df, con, sql) -> str | None:
    """None when equal, else a short description of the difference."""
    cur = con.execute(sql)
    dcols = [d[0] for d in cur.description]
    want = rows_of(dcols, cur.fetchall())
    got_rows = spark_df.collect()
    scols = spark_df.columns
    if sorted(scols) != sorted(dcols):
        return f"columns differ: spark {sorted(scols)} sql {sorted(dcols)}"
    got = rows_of(scols, [tuple(r) for r in got_rows])
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} sql {len(want)}; e.g. spark-only {list(set(got) - set(want))[:2]} sql-only {list(set(want) - set(got))[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}"
    # same Python type per column, so a strict hash agrees too
    for i in range(len(scols)):
        kinds = {type(r[i]).__name__ for r in got if r[i] is not None} ^ {type(r[i]).__name__ for r in want if r[i] is not None}
        if kinds:
            return f"type of column {sorted(scols)[i]} differs: {kinds}"
    return None
