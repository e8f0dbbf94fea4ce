import pytest

import __spark_entry__ as entry

from .compare import connection, differences

SF = "/root/testdata/sf0.001"
OWN = [n for n in entry.queries() if n != "pipeline" and not (n.startswith("op") and n[2].isdigit())]


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", OWN)
def test_rows_are_those_of_the_sql(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SF).count() >= 0
    else:
        assert not differences(spark, con, entry.queries()[name], sql, SF)


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
