"""Every query of the memory engine against its SQL, on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__
from recallforge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, con, name):
    query, sql = registry.QUERIES[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in rel.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
