"""Every query with SQL against it."""

from __future__ import annotations

import pytest

from strataspan.llm import queries

from ..compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, name):
    assert assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], connect(sf_dir)) > 0
