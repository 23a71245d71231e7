"""Every registered query against its SQL twin in DuckDB."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pavilion.plans import catalog
from pavilion.plans.adapters import TABLES

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir_module):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir_module}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def sf_dir_module():
    from conftest import SF_DIR
    return SF_DIR


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return "~" if v is None else str(v)


def _rows(rows, order):
    return sorted(tuple(_value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.entries()))
def test_query(name, spark, duck, sf_dir_module):
    df = QUERIES[name](spark, sf_dir_module)
    got = df.collect()
    columns = sorted(df.columns)
    assert name in ORACLES, "every query has an SQL twin so far"
    want = duck.execute(ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    assert _rows(got, [df.columns.index(c) for c in columns]) == _rows(want.fetchall(), [names.index(c) for c in columns])


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["player_id", "format", "matches"] and df.count() > 0
