"""Every registered query against its SQL twin on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from check_queries import connect, difference

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    problem = difference(spark, con, QUERIES[name], ORACLES.get(name), FOLDER)
    assert problem is None


def test_entry(spark):
    assert entry.entry(spark).columns == ["marca", "rango", "contactos", "deuda"]
