"""Queries over invoices below a thousand against their SQL: without marks between groups their amounts would read differently."""

from __future__ import annotations

import duckdb
import pytest
from conftest import same_rows

from vatloom.plans import registry

PRICES = (0.4, 7, 49.5, 90, 450, 898, 896.5, 999.4, 1000, 5_000)


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Orders of every remainder by 3, 5 and 7 with each of the prices."""
    sf, con = str(tmp_path_factory.mktemp("small")), duckdb.connect()
    prices = ", ".join(str(float(p)) for p in PRICES)
    con.sql(f"""COPY (SELECT CAST(row_number() OVER () AS BIGINT) AS o_orderkey, CAST(1 AS BIGINT) AS o_custkey, 'F' AS o_orderstatus, CAST(p AS DOUBLE) AS o_totalprice, TIMESTAMP '1997-03-04' AS o_orderdate
      FROM (SELECT unnest([{prices}]) AS p), range(105)) TO '{sf}/orders.parquet'""")
    con.sql(f"""COPY (SELECT o_orderkey AS l_orderkey, CAST(1 AS BIGINT) AS l_suppkey, CAST(1 AS INTEGER) AS l_linenumber, o_totalprice AS l_extendedprice, CAST(0 AS DOUBLE) AS l_discount FROM '{sf}/orders.parquet') TO '{sf}/lineitem.parquet'""")
    for name in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return sf, con


def test_default_currency(spark, small):
    sf, con = small
    same_rows(registry.QUERIES["default_currency"](spark, sf), con.sql(registry.ORACLES["default_currency"]))


def test_normalize_money(spark, small):
    sf, con = small
    same_rows(registry.QUERIES["normalize_money"](spark, sf), con.sql(registry.ORACLES["normalize_money"]))


def test_table_number(spark, small):
    sf, con = small
    same_rows(registry.QUERIES["table_number"](spark, sf), con.sql(registry.ORACLES["table_number"]))


def test_upload_split_rounds_prices(spark, tmp_path):
    """Sizes at the limits: 87,381.5 and 349,525.5 are rounded up, above them."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT CAST(row_number() OVER () AS BIGINT) AS o_orderkey, CAST(p AS DOUBLE) AS o_totalprice
      FROM (SELECT unnest([0, 87381, 87381.5, 87381.7, 87382, 349525, 349525.5, 349525.7, 349526]) AS p), range(5)) TO '{tmp_path}/orders.parquet'""")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    same_rows(registry.QUERIES["upload_split"](spark, str(tmp_path)), con.sql(registry.ORACLES["upload_split"]))
