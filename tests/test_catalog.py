"""Every query with SQL against DuckDB on the same files."""

import glob
import math
import os

import duckdb
import pytest

from tessella import catalog

catalog.load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool | int | float):
        return f"{float(v):.9g}"
    return str(v)


def test_every_query_has_sql():
    without = {"variant_outcomes", "transfer_auc", "grid_search", "surrogate_rules", "threshold_rules", "learned_router", "reviewer_adjusted_test"}
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == without


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql(spark, sf_dir, name):
    a, b = ({tuple(map(plain, r)) for r in catalog.QUERIES[name](spark, sf_dir).collect()} for _ in range(2))
    assert a == b
    assert a


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    other = duck.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    at = [other.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in other.fetchall())
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())


def test_vocabulary_has_the_reference_size(spark):
    sf_dir = "/root/testdata/sf0.01"
    ids = sorted(r.id for r in catalog.QUERIES["vocab_topk_10000"](spark, sf_dir).collect())
    assert ids == list(range(2, 10_000))
    most = max(int(x) for r in catalog.QUERIES["encoded_padded_10000"](spark, sf_dir).collect() for x in r.ids.split())
    assert most == 9999
