"""The record queries on small dirty tables: nulls everywhere, repeats, blanks, extra columns."""

import pytest

from thicket.plans import records

NODE = "id string, lcm_id string, node_type string, parent_id string, branch_id string, timestamp double, token_count long, correction_prev_id string, correction_root_id string, ingest_seq long, key string, ref string, load long"


@pytest.fixture()
def folder(spark, tmp_path):
    def write(nodes=(), edges=(), messages=(), summaries=(), branches=(), purges=(), conversations=()):
        save = lambda name, rows, schema: spark.createDataFrame(list(rows), schema).write.parquet(f"{tmp_path}/{name}.parquet")
        save("memory_nodes", [tuple(n.get(c.split()[0]) for c in NODE.split(", ")) for n in nodes], NODE)
        save("memory_edges", edges, "src_id string, dst_id string, edge_type string, created_ts double, edge_seq long, target string")
        save("messages", messages, "message_id string, conversation_id long, token_count long, created_at double, ingest_seq long")
        save("summaries", summaries, "summary_id string, created_at double")
        save("branch_states", branches, "branch_id string, last_update_ts double, node_count long")
        save("purged_records", purges, "record_table string, record_key string, purged_ts double")
        save("conversations", conversations, "conversation_id long, created_at double")
        return str(tmp_path)

    return write


def rows(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_empty_tables(spark, folder):
    d = folder()
    for name in ("p4_found", "p4_deliveries", "p5_found", "p5_hierarchy", "p6_found", "p6_orphan_report", "p7_found", "p7_conversation_loads", "p7_branch_loads"):
        assert records.QUERIES[name](spark, d).count() == 0, name


def test_all_null_rows(spark, folder):
    d = folder(nodes=[{}, {"ingest_seq": 1}], edges=[(None,) * 6] * 2, messages=[(None,) * 5], summaries=[(None, None)], branches=[(None, None, None)], purges=[(None, None, None)], conversations=[(None, None)])
    for name in ("p4_found", "p5_found", "p6_found", "p7_found", "p7_conversation_loads", "p7_branch_loads", "p6_orphan_report"):
        assert records.QUERIES[name](spark, d).count() == 0, name


def test_p5_kinds(spark, folder):
    n = lambda i, **k: {"id": i, "ingest_seq": k.pop("s"), **k}
    d = folder(nodes=[
        n("A", s=1, parent_id=" b "), n("b", s=2, parent_id="a"), n("c", s=3, parent_id="A"), n("d", s=4, parent_id="D"),
        n("r", s=5), n("v1", s=6, correction_prev_id="r", correction_root_id="R "), n("v2", s=7, correction_prev_id="v1", correction_root_id="v1"), n("v3", s=8, correction_prev_id="v1"),
        n("x", s=9, correction_prev_id="gone", correction_root_id="r"), n("y", s=10, correction_prev_id="z"), n("z", s=11, correction_prev_id="y"), n("w", s=12, correction_prev_id="z", correction_root_id="r"),
        n("v2", s=13, correction_prev_id="v1", correction_root_id="v1"),
    ])
    assert rows(records.p5_found(spark, d)) == {
        ("parent_cycle", "A"), ("parent_cycle", "b"), ("parent_cycle", "d"), ("root_mismatch", "v2"), ("root_mismatch", "v3"), ("correction_cycle", "y"), ("correction_cycle", "z")}


def test_p6_kinds_and_inheritance(spark, folder):
    n = lambda i, s, t="message", l="m1", ts=5.0, **k: {"id": i, "ingest_seq": s, "node_type": t, "lcm_id": l, "timestamp": ts, **k}
    d = folder(
        nodes=[n("n1", 1), n("n2", 2, l="gone"), n("n3", 3, parent_id="N2", l="M1 "), n("n4", 4, parent_id="n3"), n("n5", 5, t="leaf_summary", l="s1"), n("n6", 6, t="daily_log_entry", l="nothing"), n("n7", 7, t="tool_result", l="m2")],
        edges=[("n1", "B1", "t", 1.0, 1, "x"), ("agent:x", "nowhere", "t", 1.0, 2, "x"), ("n4", "n1", "t", 1.0, 3, "x"), (None, " ", "t", 1.0, 4, "x"), ("gone", "n1", "t", None, 5, "x"), ("gone", "n1", "t", None, 6, "x")],
        messages=[("m1", 1, 1, 1.0, 1), ("m2", 1, 1, 1.0, 2), ("m2", 1, 1, 9.0, 3)], summaries=[("s1", 1.0)], branches=[("b1 ", 1.0, 1)],
        purges=[("messages", "M2", 5.0), ("summaries", "s1", 5.0), ("memory_nodes", "n1", 5.0), ("memory_nodes", "n1", 3.0)])
    assert rows(records.p6_found(spark, d)) == {("lcm_id", 2), ("lcm_id", 5), ("dst_id", 2), ("src_id", 1), ("dst_id", 3), ("src_id", 5), ("src_id", 6), ("dst_id", 5), ("dst_id", 6)}
    report = {(r["ref_table"], r["ref_field"], r["kind"]): r["orphans"] for r in records._all_orphans(spark, d).groupBy("ref_table", "ref_field", "kind").count().withColumnRenamed("count", "orphans").collect()}
    assert report[("memory_nodes", "parent_id", "inherited")] == 2 and report[("memory_edges", "src_id", "inherited")] == 1


def test_p7_share_is_of_all_rows(spark, folder):
    d = folder(messages=[("m", 1, 1, 1.0, i) for i in range(30)] + [("m", 2, 1, 1.0, 100)] + [("m", None, 1, 1.0, 200 + i) for i in range(69)], nodes=[{"branch_id": b, "ingest_seq": i} for i, b in enumerate(["B", " b", "b"] + [None] * 100)])
    assert rows(records.p7_found(spark, d)) == {("messages.conversation_id", "1"), ("memory_nodes.branch_id", "b")}


def test_p5_descendants_emits_rows_and_counts_whole_circles(spark, folder):
    n = lambda i, s, p=None: {"id": i, "ingest_seq": s, "parent_id": p}
    d = folder(nodes=[n("a", 1, "b"), n("b", 2, "c"), n("c", 3, "a"), n("x", 4, "b"), n("r", 5), n("s", 6, "r")])
    below = {r for r in rows(records.p5_descendants(spark, d)) if r[0] == "parent"}
    circle = {("parent", a, c, (p - q) % 3) for q, a in enumerate((3, 2, 1)) for p, c in enumerate((3, 2, 1)) if a != c}
    assert below == circle | {("parent", 2, 4, 1), ("parent", 3, 4, 2), ("parent", 1, 4, 3), ("parent", 5, 6, 1)}
    counts = {r["nid"]: r["descendants"] for r in records.p5_hierarchy(spark, d).where("link = 'parent'").collect()}
    assert counts == {1: 3, 2: 3, 3: 3, 4: 0, 5: 1, 6: 0}
