import pytest

from ravelin.llm import registry
from tests.conftest import DATA
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_has_the_rows_of_its_sql(spark, name):
    assert_same(registry.queries()[name](spark, DATA), registry.oracle_sql()[name], DATA)


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 14))
