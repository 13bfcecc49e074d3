"""Merge scores: co-use, aliases, weights by branch type."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from thicket.config import Config
from thicket.operators import retrieval
from thicket.plans import branches

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_co_use_enters_the_merge_score_and_the_pairs(spark):
    q = entry.queries()
    whole = {(r[0], r[1]): r for r in q["merge_pairs"](spark, FOLDER).collect()}
    co = {(r["branch_a"], r["branch_b"]): r["co_use"] for r in q["retrieval_co_use"](spark, FOLDER).collect()}
    can = {r["branch_id"] for r in branches.states(spark, FOLDER).where("state IN ('STABLE', 'DORMANT')").collect()}
    can &= {r["branch_id"] for r in q["branch_stats"](spark, FOLDER).collect()}
    assert {p for p in co if set(p) <= can} <= set(whole)
    for p, r in whole.items():
        assert r["co_use"] == pytest.approx(co.get(p, 0.0), abs=1e-6)
        assert p in co or r["topic_edges"] + r["temporal_edges"] > 0 or r["topic_overlap"] == 0
    assert any(r["co_use"] > 0 for r in whole.values())


def test_weights_by_branch_type(spark):
    from dataclasses import replace

    cfg = replace(Config(), profiles={" Task ": {"g": {"a": 2.0}}, "default": {"g": {"b": 7.0}}})
    df = spark.createDataFrame([("task",), (" TASK",), ("other",), (None,)], "branch_type string")
    got = df.select(retrieval.weight(cfg, "g", "a", 1.0).alias("a"), retrieval.weight(cfg, "g", "b", 3.0).alias("b")).collect()
    # a profile that does not name a weight means the fallback, not the default profile
    assert [tuple(r) for r in got] == [(2.0, 3.0), (2.0, 3.0), (1.0, 7.0), (1.0, 7.0)]
    assert df.select(retrieval.weight(Config(), "g", "a", 1.5).alias("a")).distinct().collect()[0]["a"] == 1.5


def test_filters_of_the_cascade(spark):
    rows = [("a", "STABLE", 10.0, 0.9), ("b", "STABLE", None, 0.8), ("c", "COLLAPSING", 10.0, 0.7), ("d", "ACTIVE", 99.0, 0.6), ("e", None, 10.0, 0.5)]
    df = spark.createDataFrame(rows, "branch_id string, state string, last_update_ts double, x double").withColumn("mean_vec", F.array("x"))
    ids = lambda d: sorted(r["branch_id"] for r in d.collect())
    assert ids(retrieval.eligible(df)) == ["a", "b", "d", "e"]
    assert ids(retrieval.eligible(df, after=5.0, before=50.0)) == ["a", "e"]
    assert ids(retrieval.eligible(df, states=("COLLAPSING",))) == ["c"]
    assert ids(retrieval.eligible(df, ids=df.where("x < 0.65").select("branch_id"))) == ["d", "e"]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_ranking_does_not_sort_all_branches_in_one_task(spark):
    plan = entry.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "GlobalLimit" not in plan and "TakeOrderedAndProject" in plan
