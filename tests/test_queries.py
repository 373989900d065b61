"""Every registered query against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from rasterloom import queries_geometry  # noqa: F401
from rasterloom.queries import ORACLE, QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    rel = con.sql(ORACLE[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert ours == sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_every_customer_holds_a_tile(spark):
    d = "/root/testdata/sf0.001"
    if not Path(d).exists():
        pytest.skip("no tables")
    n = spark.read.parquet(f"{d}/customer.parquet").count()
    assert n > 40 and QUERIES["tiles_summary_all"](spark, d).count() == (n + 1) // 2
    assert QUERIES["tile_claim_available_all"](spark, d).count() == 8 * (n // 8 + 2) - n // 2
