"""Spark rows against DuckDB rows."""

import os

import duckdb


def same_rows(spark, f, sql: str, sf_dir: str) -> None:
    df = f(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted(repr(tuple(r[n] for n in names)) for r in df.collect())
    con = duckdb.connect()
    for file in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = sorted(repr(tuple(r[columns.index(n)] for n in names)) for r in found.fetchall())
    assert got == want
