"""Every registered query with SQL, against DuckDB on the smallest tables; every other one must run and have rows."""

import os

import duckdb
import pytest

from strandline import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(list(map(_cell, v))) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = sorted(tuple(_cell(r[c]) for c in columns) for r in frame.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    result = duck.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert rows == sorted(tuple(_cell(r[names.index(c)]) for c in columns) for r in result.fetchall())


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 3
