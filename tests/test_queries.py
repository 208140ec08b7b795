"""Queries against their SQL on the smallest test tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__

FOLDER = Path("/root/testdata/sf0.001")
CORE = [n for m in (__spark_entry__.catalog_queries, __spark_entry__.medallion, __spark_entry__.workload, __spark_entry__.problem_queries) for n in m.QUERIES]
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables are not here")


def plain(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple("" if r[i] is None else repr(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in at) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in FOLDER.iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, str(FOLDER))
    rows = df.collect()
    assert rows
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        got = duck.execute(sql)
        names = [d[0] for d in got.description]
        assert plain([tuple(r) for r in rows], df.columns) == plain(got.fetchall(), names)


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns


def test_workload_fills_typed_tables(spark):
    prefix = "shop_"
    names = __spark_entry__.workload.load_workload(spark, str(FOLDER), prefix)
    try:
        assert __spark_entry__.workload.load_workload(spark, str(FOLDER), prefix) == names
        kpi = spark.table(f"{prefix}gold.monthly_kpi")
        assert dict(kpi.dtypes)["revenue"] == "decimal(20,2)" and kpi.count() == 2 * kpi.select("month").distinct().count() > 0
        assert all(spark.table(n).count() for n in names)
        comments = {r.col_name: r.comment for r in spark.sql(f"DESCRIBE {prefix}silver.orders_cleaned").collect()}
        assert comments["amount"] == "converted"
    finally:
        for layer in ("silver", "gold", "legacy", "mart"):
            spark.sql(f"DROP SCHEMA IF EXISTS {prefix}{layer} CASCADE")
