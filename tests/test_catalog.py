"""Every registered query against its SQL, on the smallest tables."""

import decimal
from pathlib import Path

import duckdb
import pytest

from tessera.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for file in Path(sf).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in catalog.ORACLES:
        assert got or name == "backfill"
        return
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
