import pytest

from groundq.llm import queries
from tests.compare import database, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, name):
    same(queries.queries()[name](spark, SF), database(SF).sql(queries.oracle_sql()[name]))


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))
