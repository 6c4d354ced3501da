"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import pytest
from conftest import SF, same_rows

from vatloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, name):
    same_rows(registry.QUERIES[name](spark, SF), duck.sql(registry.ORACLES[name]))


def test_every_query_has_sql_or_a_test_here():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"line_clustering"}


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert "rate" in df.columns and df.count() >= 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
