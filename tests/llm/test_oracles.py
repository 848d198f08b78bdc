"""The SQL of this subpackage against its queries."""

from __future__ import annotations

import duckdb
import pytest

from kvarn.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "pages"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = c.sql(queries.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(x) for x in cols]
    assert sorted((tuple(r[x] for x in cols) for r in df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
