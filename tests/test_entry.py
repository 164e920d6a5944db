"""The driver's contract, and every query with an oracle against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans.catalog import ORACLES, QUERIES
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    made = QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    rows = [tuple(r) for r in made.select(columns).collect()]
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert sorted(map(repr, rows)) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
