"""Every core query with SQL gives the same rows in Spark and DuckDB on the smallest tables."""

from pathlib import Path

import pytest
from oracle import compare, connection

from sparkcurate.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connection(D)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, name):
    assert compare(spark, registry.QUERIES[name], registry.SQL[name], D, duck) == []


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    registry.QUERIES[name](spark, D).collect()
