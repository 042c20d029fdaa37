"""Every registered query next to its SQL, on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.compare import connect, difference, spark_rows, sql_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    ours = spark_rows(queries()[name](spark, SF))
    assert ours[1]
    if name in oracle_sql():
        assert difference(ours, sql_rows(con, oracle_sql()[name])) is None


def test_entry(spark):
    assert entry(spark).count() > 0
