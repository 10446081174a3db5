"""Every registered query against its SQL on the smallest tables."""

import pytest

from seamark.plans import QUERIES, SQL
from tests import oracle
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert oracle.difference(QUERIES[name](spark, SMALL), duck, SQL[name]) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
