"""Every query of the engine against its SQL oracle on the smallest tables, and the driver's contract."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from sparkweave.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cursor = duck.execute(registry.ORACLE[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = Counter(tuple(map(plain, r)) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_queries_without_an_oracle_have_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(registry.QUERIES) <= set(entry.queries())
