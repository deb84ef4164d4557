import pytest

from groundq.plans import catalogue
from tests.compare import database, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, name):
    assert same(catalogue.queries()[name](spark, SF), database(SF).sql(catalogue.oracle_sql()[name])) > 0


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and all(r.refused or "\n" in r.final_answer for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())
