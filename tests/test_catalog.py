from __future__ import annotations

import pytest

from gritstone.plans import catalog

from .compare import check, connect
from .conftest import data


@pytest.fixture(scope="module")
def con():
    return connect(data("sf0.001"))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    check(spark, data("sf0.001"), catalog.queries()[name], catalog.oracle_sql()[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert catalog.queries()[name](spark, data("sf0.001")).count() > 0


def test_flagship(spark):
    assert catalog.ranked_issues(spark, data("sf0.001")).count() > 0
