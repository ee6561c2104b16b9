"""Every query of the engine's own against its DuckDB equivalent, on whole small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from brightwake import catalog
from brightwake import queries as _all  # noqa: F401

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


def rounded(row):
    return repr(tuple(round(v, 9) if isinstance(v, float) else v for v in row))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"create view {name} as select * from '{data}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_duckdb(name, spark, data, duck):
    found = QUERIES[name](spark, data)
    columns = sorted(found.columns)
    asked = duck.execute(SQL[name])
    names = [c[0] for c in asked.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(rounded(r[i] for i in places) for r in asked.fetchall())
    assert sorted(rounded(tuple(r)) for r in found.select(*columns).collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert os.path.isdir(data)
    assert QUERIES[name](spark, data).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
