"""The cut of keyword matches leaves out exactly what lies beyond it; co-use against hand-computed values."""

import pytest
from pyspark.sql import functions as F

from thicket.operators import feedback, keyword, retrieval


def test_the_newest_matches_of_a_term(spark):
    rows = [(1, f"m{i}", i, "alpha beta" if i % 2 else "alpha", float(i % 7) if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "conversation_id long, message_id string, ingest_seq long, content string, created_at double")
    each = keyword.matches(df, ["alpha", "beta"], None).select("ingest_seq", "created_at", F.inline("hits"))
    order = [F.col("created_at").desc_nulls_last(), F.col("ingest_seq")]
    got = {(r["term"], r["ingest_seq"]) for r in retrieval.top_per_group(each, ["term"], order, 6).collect()}
    best = lambda odd: sorted((r for r in rows if not odd or r[2] % 2), key=lambda r: (r[4] is None, -(r[4] or 0), r[2]))[:6]
    assert got == {("alpha", r[2]) for r in best(False)} | {("beta", r[2]) for r in best(True)}


def _feedback(spark, rows):
    return spark.createDataFrame(rows, "seq long, query_id string, branch_id string, used boolean, timestamp double")


def test_co_use_by_hand(spark):
    # q1: a used, b not; q2: both used; q3: a alone; q4: b alone, twice
    rows = [(1, "q1", "a", True, 1.0), (2, "q1", "b", False, 1.0), (3, "q2", "a", True, 2.0), (4, "q2", "b", True, 2.0), (5, "q3", "a", False, 3.0), (6, "q4", "b", None, 4.0), (7, "q4", "b", True, 4.0)]
    r = feedback.co_use(_feedback(spark, rows)).collect()
    assert len(r) == 1 and (r[0]["branch_a"], r[0]["branch_b"], r[0]["shared"], r[0]["queries"]) == ("a", "b", 2, 4)
    assert r[0]["co_use"] == pytest.approx(2 / 4 * (0.5 + 0.5 * (0.5 + 1.0) / 2))
    # the newest five rows of the pair are those of q4, q3 and q2; q1 falls out
    r = feedback.co_use(_feedback(spark, rows), lookback=5).first()
    assert (r["shared"], r["queries"]) == (1, 3) and r["co_use"] == pytest.approx(1 / 3)
    assert feedback.co_use(_feedback(spark, [])).count() == 0


def test_co_use_with_lookback_against_brute_force(spark):
    import random

    rng = random.Random(4)
    rows = [(i, f"q{rng.randrange(60)}", rng.choice("abcd"), rng.random() < 0.4, float(rng.randrange(50))) for i in range(400)]
    for lookback in (30, 150, 1000):
        got = {(r["branch_a"], r["branch_b"]): (r["shared"], r["queries"], round(r["co_use"], 9)) for r in feedback.co_use(_feedback(spark, rows), lookback).collect()}
        want = {}
        for a, b in [(x, y) for x in "abcd" for y in "abcd" if x < y]:
            new = sorted((r for r in rows if r[2] in (a, b)), key=lambda r: (-r[4], -r[0]))[:lookback]
            per = {}
            for r in new:
                per.setdefault(r[1], {}).setdefault(r[2], []).append(r[3])
            both = [v for v in per.values() if a in v and b in v]
            if both:
                q = sum((max(v[a]) + max(v[b])) / 2 for v in both) / len(both)
                want[a, b] = (len(both), len(per), round(len(both) / len(per) * (0.5 + 0.5 * q), 9))
        assert got == want
