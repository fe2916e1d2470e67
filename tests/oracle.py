"""Compare a Spark query with its DuckDB SQL on the same Parquet tables."""

import glob
import os

import duckdb

DATA = "/root/testdata"


def duck(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
        name = os.path.basename(path)[:-8]
        src = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{src}'")
    return con


def canon(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, (list, tuple)):
        return [canon(x) for x in v]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(str(canon(r[i])) for i in order) for r in rows])


def check(spark, name, fn, sql, sf="sf0.001"):
    df = fn(spark, f"{DATA}/{sf}")
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = duck(sf).execute(sql)
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert got[0] == want[0], (name, got[0], want[0])
    assert len(got[1]) == len(want[1]), (name, len(got[1]), len(want[1]))
    for a, b in zip(got[1], want[1], strict=True):
        assert a == b, (name, a, b)
    return len(got[1])
