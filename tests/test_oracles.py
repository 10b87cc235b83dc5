"""Every registered query equals its SQL on the smallest tables."""

import importlib.util
import math
import os
from decimal import Decimal

import duckdb
import pytest

from cardflow import oracles
from cardflow import queries as catalog
from tests.conftest import DATA

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SPEC = importlib.util.spec_from_file_location("entry", f"{_ROOT}/__spark_entry__.py")
entry = importlib.util.module_from_spec(_SPEC)
_SPEC.loader.exec_module(entry)
QUERIES, ORACLES = catalog.all_queries(), oracles.all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "customer"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, Decimal):
        return float(value)
    return None if isinstance(value, float) and math.isnan(value) else value


def ordered(rows, names):
    places = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in places) for r in rows), key=repr)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and ORACLES.items() <= entry.oracle_sql().items()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(ORACLES[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = ordered(result.fetchall(), names)
    assert expected
    assert ordered(df.collect(), df.columns) == expected


def test_entry(spark):
    assert entry.entry(spark).count() > 0
