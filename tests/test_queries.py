"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from glyphmill.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def rows(df):
    df = df[sorted(df.columns)].astype(object)

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return v if isinstance(v, str) else float(v)

    return sorted(str([cell(v) for v in r]) for r in df.to_numpy().tolist())


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES) - {"trie_suggest"}))
def test_kernel_query_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_entry():
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
