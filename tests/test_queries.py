"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomtrace.plans import indexes, passthrough, streams, upkeep, views

SF = "/root/testdata/sf0.001"
QUERIES, SQL = {**upkeep.QUERIES, **indexes.QUERIES, **streams.QUERIES, **passthrough.QUERIES}, {**upkeep.SQL, **indexes.SQL, **streams.SQL, **passthrough.SQL}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in views.TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def shown(row, names):
    return tuple(repr(round(v, 9) + 0.0) if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v) for v in (row[n] for n in names))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    names = sorted(columns)
    want = sorted(shown(dict(zip(columns, r)), names) for r in cursor.fetchall())
    assert sorted(shown(r.asDict(), names) for r in got.collect()) == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
