"""Compare a query with its SQL: columns by name, rows in any order, doubles to 9 digits."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(f"{float(x):.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def rows_of(df):
    order = sorted(df.columns)
    return order, sorted(repr([plain(r[c]) for c in order]) for r in df.collect())


def rows_of_sql(con, sql):
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(names)
    return order, sorted(repr([plain(r[names.index(c)]) for c in order]) for r in got.fetchall())


def difference(df, con, sql) -> str:
    a, b = rows_of(df), rows_of_sql(con, sql)
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} / {len(b[1])}: {sorted(set(a[1]) - set(b[1]))[:2]} / {sorted(set(b[1]) - set(a[1]))[:2]}"
    if a[1] != b[1]:
        return f"values: {[x for x in a[1] if x not in set(b[1])][:2]} / {[x for x in b[1] if x not in set(a[1])][:2]}"
    return ""
