"""Every registered query against its SQL oracle on the smallest tables."""
import pytest

import __spark_entry__ as entry
from tests.check import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.count() >= 0
        return
    problem, _ = compare(df, con, sql)
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
