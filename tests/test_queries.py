"""Every query of the catalogue that SQL states, against DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from papyrine.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = [x[: -len(".parquet")] for x in os.listdir(SF)] if os.path.isdir(SF) else []
pytestmark = pytest.mark.skipif(not TABLES, reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    want = con.sql(catalog.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(list(want.columns), want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_programs_give_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).count() > 0
