import pytest

from tests.compare import connection, differences
from tidepool.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, name):
    assert not differences(spark, connection(SF), QUERIES[name], ORACLE_SQL[name], SF)
