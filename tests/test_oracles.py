"""Every registered query that has SQL, against DuckDB on whole tables.

``ORACLE_SF_DIR`` picks other data, ``ORACLE_QUERIES`` a few queries.
"""

import os

import pytest

import __spark_entry__ as contract
from tests.compare import connect, difference

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SQL = contract.oracle_sql()
QUERIES = contract.queries()
NAMES = os.environ.get("ORACLE_QUERIES", ",".join(SQL)).split(",")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, SF_DIR, QUERIES[name], SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_without_sql(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    assert df.count() > 0


def test_entry(spark):
    assert contract.entry(spark).columns == [
        "id",
        "indegree",
        "outdegree",
        "average_neighbor_degree",
        "triangles",
        "clustering_coefficient",
        "kCore",
    ]
