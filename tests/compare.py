"""Rows of a Spark query and of its SQL, in a form that can be compared."""

import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def database():
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(x) for x in r) for r in df.select(*[df[c] for c in columns]).collect()), key=repr)


def rows_of_sql(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cursor.fetchall()), key=repr)
