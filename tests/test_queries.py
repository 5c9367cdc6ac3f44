"""Every registered ledger query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import decimal
import glob
import os

import pytest

from ledgerloom.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(FOLDER):
        pytest.skip("the given tables are not here")
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(registry.queries()))
def test_query_equals_sql(spark, oracle, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    assert sql, "every ledger query has SQL"
    rel = oracle.sql(sql)
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in places]) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert set(registry.queries()) <= set(__spark_entry__.queries()) and set(registry.oracle_sql()) <= set(__spark_entry__.oracle_sql())
    assert __spark_entry__.entry(spark).count() > 0
