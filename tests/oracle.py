"""Runs a query and its SQL over the same tables and compares rows, order aside."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if hasattr(v, "as_tuple"):  # Decimal
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def differences(spark, sf_dir, query, sql, c):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = c.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if sorted(df.columns) != sorted(d[0] for d in cur.description):
        return f"columns {df.columns} and {[d[0] for d in cur.description]}"
    if got != want:
        miss = [r for r in want if r not in got][:2]
        more = [r for r in got if r not in want][:2]
        return f"{len(got)} rows, {len(want)} expected; missing {miss}; more {more}"
    return None
