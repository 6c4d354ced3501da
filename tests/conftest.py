"""One Spark session for all tests, with a shared folder as a cluster would name it."""

from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

SF_SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(root / "local"))
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .config("spark.checkpoint.dir", str(root / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB with the tables of the middle size as views."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value) -> str:
    """A value as text, the same for Spark's and DuckDB's types."""
    import decimal

    if value is None or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, (float, decimal.Decimal)) and not isinstance(value, bool):
        return f"{float(value):.9g}"
    return str(value)


def same_rows(df, relation) -> None:
    """Assert that a DataFrame and a DuckDB relation have the same columns and rows."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = {c: i for i, c in enumerate(relation.columns)}
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    theirs = sorted(tuple(plain(r[at[c]]) for c in names) for r in relation.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
