"""The llm queries on the smallest tables: those with SQL against DuckDB, the others run."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare, connection

from sparkcurate.llm import queries

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(D).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, name):
    assert compare(spark, queries.QUERIES[name], queries.SQL[name], D, connection(D)) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    queries.QUERIES[name](spark, D).collect()
