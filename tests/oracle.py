"""Compare a registered query with its SQL on DuckDB."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(cols, records):
    key = lambda row: tuple((x is None, str(type(x)), str(x)) for x in row)
    return sorted((tuple(norm(r[c]) for c in cols) for r in records), key=key)


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = df.toArrow().to_pylist()
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    want = [dict(zip(names, row)) for row in result.fetchall()]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    a, b = rows_of(cols, got), rows_of(cols, want)
    assert len(a) == len(b)
    assert a == b
