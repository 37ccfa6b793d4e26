"""Compares a query with its SQL on the driver's tables."""

import os

import duckdb


def rounded(rows, columns, names):
    at = [names.index(c) for c in columns]
    plain = lambda x: round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


def compare(spark, sf_dir, query, statement):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    got = query(spark, sf_dir)
    want = con.sql(statement)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert rounded(got.collect(), columns, got.columns) == rounded(want.fetchall(), columns, want.columns)
