"""Every query with an oracle against it, on the smallest tables."""

from __future__ import annotations

import datetime
import math

import pytest

from loomgraph.plans import registry
from loomgraph.sources.fixtures import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    con = duckdb.connect()
    for t in BASE:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, oracle, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    other = oracle.sql(registry.oracle_sql()[name])
    assert sorted(other.columns) == columns
    at = [list(other.columns).index(c) for c in columns]
    assert found == sorted(str([plain(r[i]) for i in at]) for r in other.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_only(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
