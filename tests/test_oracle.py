"""Every registered query against its SQL in DuckDB on the smallest sample."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from registry import ORACLES, QUERIES
from tests.conftest import SMALL
from tools.check import compare, connect


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    outcome = compare(spark, duck, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert outcome.startswith("ok"), outcome


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(oracle_sql()) <= set(queries())


def test_entry_gives_edges(spark):
    df = entry(spark)
    assert df.columns == ["id", "source", "target", "label"]
    assert df.count() > 0
