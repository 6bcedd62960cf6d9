"""Every query with SQL gives that SQL's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from stancelake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


def same_rows(spark, sf, query, sql):
    frame = query(spark, sf)
    names = sorted(frame.columns)
    got = sorted(tuple(plain(x) for x in row) for row in frame.select(names).collect())
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    result = connection.sql(sql)
    assert sorted(result.columns) == names
    order = [result.columns.index(n) for n in names]
    assert got == sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, name):
    same_rows(spark, sf, registry.queries()[name], registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, sf, name):
    assert registry.queries()[name](spark, sf).count() > 0
