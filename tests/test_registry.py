"""Every registered query of the library against its SQL on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from linework.plans import registry

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, list | tuple):
        return tuple(map(plain, value))
    return value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
