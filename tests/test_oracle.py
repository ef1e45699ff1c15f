"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from farelake import registry
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    message, rows, _ = compare(spark, con, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert message is None
    assert rows > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 25
    assert df.columns[0] == "city"


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)
    assert set(registry.QUERIES) <= set(entry.queries())
