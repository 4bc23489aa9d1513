"""Rows of a query's SQL in DuckDB, comparable with the rows that Spark gives."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def views(sf_dir):
    c = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return int(value)
    return str(value) if not isinstance(value, (int, float, str, type(None))) else value


def rows(names, values):
    return sorted((tuple(plain(v) for v in row) for row in values), key=repr), names


def same(spark_frame, connection, sql):
    names = sorted(spark_frame.columns)
    got, _ = rows(names, [[r[n] for n in names] for r in spark_frame.collect()])
    relation = connection.sql(sql)
    assert sorted(relation.columns) == names
    order = [relation.columns.index(n) for n in names]
    want, _ = rows(names, [[r[i] for i in order] for r in relation.fetchall()])
    assert len(got) == len(want)
    assert got == want
