"""Every bound query against its oracle SQL on the smallest tables."""

import pytest
from oracle import compare, connect

from biotope.workload import bindings

FOLDER = "/root/testdata/sf0.001"
BOUND = bindings()
WITH_SQL = [name for name, b in BOUND.items() if b.sql is not None]
ROWS_ONLY = [name for name, b in BOUND.items() if b.sql is None]


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_oracle(spark, con, name):
    binding = BOUND[name]
    result = compare(binding.run(spark, FOLDER), con, binding.oracle())
    assert result["problems"] == []
    assert result["rows"] > 0


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_gives_rows(spark, name):
    assert BOUND[name].run(spark, FOLDER).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(BOUND) <= set(entry.queries())
