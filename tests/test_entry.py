"""The queries against their SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tessera.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")
#: Training takes long; the others are run whole.
SLOW = {"als_train_topk", "kmeans_train_sizes", "forest_train_accuracy", "forest_train_rmse", "hyperparam_best_k"}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v if isinstance(v, (str, bool)) or not hasattr(v, "__float__") else float(v) + 0.0


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = duck.execute(catalogue.SQL[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(map(plain, r)) for r in got.fetchall()), key=key)
    have = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert have == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert SLOW <= set(entry.queries())
