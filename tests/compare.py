"""Rows of a Spark query against those of DuckDB, whatever their order."""

import math
import numbers
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    db = duckdb.connect()
    for name in TABLES:
        if os.path.exists(path := f"{folder}/{name}.parquet"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, numbers.Number):
        return repr(round(float(v), 6) + 0.0)
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


def same(df, relation):
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(plain(r[relation.columns.index(c)]) for c in names) for r in relation.fetchall())
    assert ours == theirs
    return len(ours)
