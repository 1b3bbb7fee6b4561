from __future__ import annotations

import pytest

from tessellar.llm import queries
from tests.oracle import compare, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_its_oracle(spark, name):
    compare(spark, connect(), queries.queries()[name], queries.oracle_sql()[name])
