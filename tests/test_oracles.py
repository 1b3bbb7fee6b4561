from __future__ import annotations

import pytest

from tessellar import catalogue

from .oracle import SF, compare, connect


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_its_oracle(spark, con, name):
    compare(spark, con, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs_without_an_oracle(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
