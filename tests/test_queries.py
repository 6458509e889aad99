"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracles import compare, database

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return database(SF)


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    verdict, line = compare(spark, db, SF, QUERIES[name], ORACLE.get(name))
    assert verdict in ("ok", "rows"), line


def test_entry(spark):
    assert entry.entry(spark).count() > 0
