import os

import pytest
from pyspark.sql import functions as F

from thicket import engine
from thicket.sources.store import Store

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture()
def memory(spark, tmp_path):
    return engine.Memory(spark, FOLDER, Store(spark, str(tmp_path)))


def vector(memory):
    return [float(x) for x in memory.nodes().where(F.size("embedding") == 64).orderBy("ingest_seq").first()["embedding"]]


def test_search_report_content(memory):
    v = vector(memory)
    found = memory.search("retrieval step", v, recency_boost=0.2)
    assert set(found) == {"geometry", "collapsing", "keyword", "daily_log"} and found["geometry"].count() == 5 and found["keyword"].count() > 0
    best = found["geometry"].first()["branch_id"]
    assert memory.branch_report(best.upper() + " ")["branch_id"] == best and sum(memory.branch_report(best)["roles"].values()) > 0
    with pytest.raises(engine.UnknownBranch):
        memory.branch_report("nowhere")
    assert memory.content("conv_1").count() > 0 and memory.nearest_nodes(v, 3).count() == 3
    assert memory.snapshot(state="all", limit=3).count() == 3 and memory.stats().count() > 0


def test_corrections_start_with_the_latest(memory):
    node = memory.nodes().where("correction_version > 1").first()["id"]
    chain = memory.latest_correction(node).collect()
    assert chain[0]["correction_version"] == max(r["correction_version"] for r in chain)


def test_writing(memory, spark):
    before = memory.nodes().count()
    dup = memory.deduplicate().count()
    assert dup > 0 and memory.nodes().count() == before - dup
    memory.add_log_entry("a short entry", "2026-03-31", 1774950000.0, [0.5] * 64)
    assert memory.nodes().where("branch_id = 'day_2026-03-31' AND node_type = 'daily_log_entry'").count() >= 1
    with pytest.raises(ValueError):
        memory.add_log_entry("x", "31.03.2026", 0.0, [0.5] * 64)
    rows = spark.createDataFrame([(1, "q", "conv_1", 0.5, True, False, False, None, engine.AS_OF - 5)], engine.FEEDBACK)
    stored = memory.branches().where("branch_id = 'conv_1'").first()["usefulness"]
    assert memory.record_feedback(rows).first()["usefulness"] == pytest.approx(0.1 + 0.9 * stored)
    # the next one goes on from there
    assert memory.record_feedback(rows, " Implicit ").first()["usefulness"] == pytest.approx(0.1 + 0.9 * (0.1 + 0.9 * stored))
    assert {r["feedback_source"] for r in memory.store.read("retrieval_feedback").collect()} == {"explicit", "implicit"}
    assert memory.maintain().count() == memory.branches().count()


def test_backfill(memory):
    out = {r["conversation_id"]: r["status"] for r in memory.backfill([1, 1, -3, 10**9], resume=False).collect()}
    assert out == {1: "processed", 10**9: "skipped_empty"} and memory.store.read("backfilled_nodes").count() <= 200
    assert {r["status"] for r in memory.backfill([1], dry_run=True).collect()} == {"skipped_resume"}


def test_jobs_and_edges(memory, spark):
    first = memory.enqueue("split", "conv_1", '{"score": 0.5}', 1.0)
    memory.enqueue("split", "conv_1", None, 2.0)
    memory.enqueue("merge", None, None, 3.0)
    assert [r["created_ts"] for r in memory.pending_jobs().collect()] == [1.0, 3.0]
    memory.complete(first)
    assert [r["job_type"] for r in memory.pending_jobs().collect()] == ["merge"]
    new = spark.createDataFrame([("X", "y", "same_topic", 0.1, 1.0, 10**9), ("x ", "Y", "same_topic", 0.9, 2.0, 10**9 + 1)], "src_id string, dst_id string, edge_type string, weight double, created_ts double, edge_seq long")
    memory.add_edges(new)
    assert [r["weight"] for r in memory.edges().where("src = 'x'").collect()] == [0.9]


def test_state_model_and_cursor(memory):
    from thicket.functions import embed

    assert memory.get_state("x") is None
    memory.set_state("x", "1")
    memory.set_state("x", "2")
    assert memory.get_state("x") == "2"
    memory.use_model({"backend": "hashing", "dim": 64})
    with pytest.raises(embed.OtherModel):
        memory.use_model({"backend": "hashing", "dim": 32})
    n = memory.branches().count()
    first = memory.next_branches(n - 1)
    again = memory.next_branches(3)
    assert len(set(first)) == n - 1 and len(again) == 3 and again[0] not in first and again[1:] == first[:2]
