"""Registered queries next to their SQL at the smallest scale."""

import pytest

import __spark_entry__ as entry
from checks import registry
from compare import duck, rows_of_duck, rows_of_spark

#: tests/llm runs the queries of the training-data operators
NAMES = [n for n in registry.queries() if n in registry.oracles()]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, con, name):
    assert rows_of_spark(entry.queries()[name](spark, sf)) == rows_of_duck(con, entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
