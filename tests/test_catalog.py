"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from kvarn.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql(spark, sf, duck, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)


def test_entry_has_rows(spark, sf):
    assert catalog.entry(spark, sf).count() > 0


def test_page_numbers_are_checked(spark):
    from kvarn.operators import scan

    with pytest.raises(ValueError):
        scan.page(spark.range(1).selectExpr("'a' as key"), 0, 10)


def test_range_filter_reaches_the_scan(spark, tmp_path):
    from kvarn.operators import scan, state

    spark.createDataFrame([(1, 1, "a", "x"), (2, 1, "b", "y")], "lsn long, op int, key string, value string").write.parquet(str(tmp_path / "log"))
    df = state.live(scan.inclusive(spark.read.parquet(str(tmp_path / "log")), "a", "a"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key,a)" in plan and [r["value"] for r in df.collect()] == ["x"]
