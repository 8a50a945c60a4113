"""Every registered query of the library runs; those with SQL give its rows."""

from __future__ import annotations

import pytest

from strataspan.queries import all_queries

from .compare import assert_same, connect

ALL = all_queries()


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, sf_dir, name):
    run, sql = ALL[name]
    df = run(spark, sf_dir)
    if sql is None:
        assert df.columns and df.count() > 0, "no rows"
    else:
        assert assert_same(df, sql, connect(sf_dir)) > 0, "no rows"
