"""Every registered query against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF), duck.sql(ORACLES[name])) is None


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["platform", "country_code", "install_date"]
