"""Queries with SQL give the SQL's rows on the smallest tables; the others run."""

import pytest
from tests.sqlcheck import connect, same_rows

from tracequarry.llm import queries as Q

SQL, RUN = Q.oracle_sql(), Q.queries()


@pytest.fixture(scope="module")
def con(tiny):
    return connect(tiny)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, tiny, con, name):
    same_rows(RUN[name](spark, tiny), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(RUN) - set(SQL)))
def test_runs(spark, tiny, name):
    assert RUN[name](spark, tiny).count() > 0
