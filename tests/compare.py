"""Rows of Spark and of DuckDB in one form."""

import os

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{name}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def same(spark_df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(spark_df.columns)
    assert rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()]) == rows_of(names, cur.fetchall())
