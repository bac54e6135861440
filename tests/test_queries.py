"""Every query with SQL equals DuckDB's rows on the smallest tables; the entry point holds together."""

import glob
import os

import pytest

import __spark_entry__ as entry_point
from skein.plans import registry

DATA = os.environ.get("SKEIN_TEST_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, duck, name):
    a, b = registry.QUERIES[name](spark, DATA).toPandas(), duck.sql(registry.ORACLES[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    x, y = (f[cols].astype(str).sort_values(cols).reset_index(drop=True) for f in (a, b))
    assert x.equals(y)


def test_entry(spark):
    assert entry_point.entry(spark).count() >= 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
