import pytest

from ravelin.plans import catalog
from tests.conftest import DATA
from tests.oracle import assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_has_the_rows_of_its_sql(spark, name):
    assert_same(catalog.queries()[name](spark, DATA), SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
