"""Rows of a query against its SQL in DuckDB, rounded and in any order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    return (None if math.isnan(v) else round(v, 6) + 0.0) if isinstance(v, float) else v


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)


def sql_rows(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(_plain(x[i]) for i in order) for x in r.fetchall()), key=repr)
