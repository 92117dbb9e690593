"""Runs a query's SQL in DuckDB on the same tables, and compares rows without regard to their order."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    return str([plain(x) for x in value]) if isinstance(value, list | tuple) else str(value)


def rows(table):
    names = sorted(table.column_names)
    return names, sorted("\x01".join(plain(r[c]) for c in names) for r in table.to_pylist())


def assert_same(df, sql, sf_dir):
    got, wanted = rows(df.toArrow()), rows(duck(sf_dir).sql(sql).to_arrow_table())
    assert got[0] == wanted[0]
    assert got[1] == wanted[1]
