"""A query's rows beside those of its SQL."""

import glob
import os
from collections import Counter
from decimal import Decimal

import duckdb

SMALL = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, (float, Decimal)):
        return f"{float(value):.6g}"
    return str(value)


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def rows_of_sql(sql, folder=SMALL):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
