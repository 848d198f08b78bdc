"""Known figures of the fixture views on the 0.01 tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from kvarn.operators import sketches, state, tablet
from kvarn.plans import catalog
from kvarn.sources import views

SF = "/root/testdata/sf0.01"


def test_state(spark):
    assert tuple(catalog.state_stats(spark, SF).first()) == (1870, 48, 10000)
    assert catalog.snapshot_at_lsn(spark, SF).count() == 1671


def test_replicas(spark):
    got = {r["relation"]: r["n"] for r in catalog.repair_actions(spark, SF).collect()}
    assert got == {"equal": 1897, "after": 175, "before": 173, "concurrent": 67, "missing_there": 24, "missing_here": 21}
    kept = catalog.reconcile_context(spark, SF).groupBy("siblings").count().collect()
    assert {r["siblings"]: r["count"] for r in kept} == {1: 2242, 2: 115}


def test_split_of_the_whole_state(spark):
    rows = state.live(views.kv_log(spark, SF)).withColumn("tablet", F.lit("all"))
    assert tablet.split_boundaries(rows).first()["boundary"] == "u000076/11"


def test_sketches(spark):
    users = views.table(spark, SF, "events").select(F.col("user_id").cast("string").alias("u"))
    assert sketches.hll_estimate(sketches.hll(users, "u", 14), 14).first()[0] == 149
    w, d = sketches.cms_size(0.01, 0.01)
    assert sketches.cms_estimate(sketches.cms(users, "u", w, d), users, "u", w, d).agg(F.sum("estimate")).first()[0] == 10053


@pytest.mark.parametrize("name", ["replica_assignment", "proposal_id"])
def test_values_without_sql_are_stable(spark, name):
    a, b = (sorted(map(tuple, catalog.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert a == b and a
