"""Every registered ledger query gives the rows of its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

from kontolith.plans.registry import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
TABLES = ("orders", "lineitem", "customer", "part", "events", "supplier")


def plain(v):
    if v is None or v != v or str(v) == "NaT":
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    if hasattr(v, "hour"):
        v = v.date()
    if isinstance(v, (str, bool)):
        return str(v)
    try:
        return None if math.isnan(float(v)) else f"{float(v):.2f}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), c.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_stream_appends_once(spark):
    n = spark.read.parquet(f"{DATA}/orders.parquet").count()
    assert QUERIES["append_stream"](spark, str(DATA)).count() == n


def test_entry_contract():
    import __spark_entry__ as e

    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
