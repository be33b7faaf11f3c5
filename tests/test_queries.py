"""Every registered query with SQL against DuckDB, at the smallest scale."""

import datetime
import math

import duckdb
import pytest

from ploidlens import plans

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, data):
    order = sorted(range(len(names)), key=lambda k: names[k])
    plain = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else str(v) if isinstance(v, (float, datetime.datetime)) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(plans.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, DIR)
    got = duck.sql(plans.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(got.columns)
    assert rows(df.columns, df.collect()) == rows(got.columns, got.fetchall())
