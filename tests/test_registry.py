"""Each registered query of the library against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomshift.plans.catalogue import QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = [f[: -len(".parquet")] for f in sorted(os.listdir(DATA)) if f.endswith(".parquet")]


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_duckdb(spark, oracle, name):
    query = QUERIES[name]
    got = query.run(spark, DATA)
    rows = sorted(tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect())
    assert query.sql, f"{name} has no SQL"
    want = oracle.sql(query.sql)
    order = [want.columns.index(c) for c in sorted(want.columns)]
    assert sorted(got.columns) == sorted(want.columns)
    assert rows == sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
