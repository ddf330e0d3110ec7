"""Compare a query with its SQL on one data folder."""

import math
from pathlib import Path

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def shown(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.9g}"
        return repr(v)

    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def agree(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    theirs = rows_of(names, got.fetchall())
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    assert mine == theirs, next((a, b) for a, b in zip(mine, theirs) if a != b)
    return len(mine)
