import random

from pyspark.sql import functions as F

from thicket.llm import conversations as c

SCHEMA = "message_id string, conversation_id long, seq long, role string, content string, ingest_seq long, n long"


def frames(spark, rows, ids=()):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(i,) for i in ids], "conversation_id long")


def dropped(spark, rows, ids=()):
    v = c.verdicts(*frames(spark, rows, ids)).collect()
    assert len({r["conversation_id"] for r in v}) == len(v)
    return {r["conversation_id"]: set(r["reasons"]) for r in v if r["reasons"]}


def talk(conv, roles, start=1, text="x", at=0):
    return [(f"c{conv}m{i}", conv, start + i, r, text, at + i, 0) for i, r in enumerate(roles)]


def test_each_reason(spark):
    rows = talk(1, ["user", "assistant"]) + talk(2, ["Human ", " AI"], start=0) + talk(3, ["user"]) + talk(4, ["assistant"]) + talk(5, ["user", "assistant", "user"])
    rows += talk(6, ["user", "???", "assistant"]) + talk(7, ["user", "assistant"], start=2) + [("g1", 8, 1, "user", "x", 1, 0), ("g2", 8, 3, "assistant", "x", 2, 0)]
    rows += [("h1", 9, 1, "user", "x", 1, 0), ("h2", 9, None, "assistant", "x", 2, 0)] + [("i1", 10, 1, "user", "x", 1, 0), ("i2", 10, 2, "assistant", "​  ", 2, 0), ("i3", 10, 3, "bot", "x", 3, 0)]
    rows += [("j1", 11, 1, "user", "​", 1, 0), ("j2", 11, 2, "assistant", None, 2, 0)] + [("k1", 12, 1, "user", "x", 1, 0), ("k2", 12, 1, "assistant", "x", 2, 0)]
    rows += [("s", None, 1, "user", "x", 1, 0)]
    got = dropped(spark, rows, [1, 2, 99, None])
    assert 1 not in got and 2 not in got
    assert {k: v for k, v in got.items() if k in (3, 4, 5, 6, 7, 8, 9, 10, 12, 99)} == {
        3: {"no_assistant", "unanswered"}, 4: {"no_user", "unanswered"}, 5: {"unanswered"}, 6: {"unknown_role"}, 7: {"numbering"}, 8: {"numbering"}, 9: {"no_seq", "numbering", "unanswered"}, 10: {"mute_assistant"},
        12: {"numbering", "unanswered"}, 99: {"empty", "unanswered"}}
    assert "empty" in got[11]


def test_redelivered_rows_count_once_and_edits_win(spark):
    rows = talk(1, ["user", "assistant"]) + [("C1M0 ", 1, 1, "user", "x", 50, 0)] * 3
    assert dropped(spark, rows) == {}
    edit = talk(2, ["user", "assistant"]) + [("c2m1", 2, 2, "assistant", "better", 60, 0)]
    t = {(r["turn"], r["content"]) for r in c.transcript(*frames(spark, edit)).collect()}
    assert t == {(1, "x"), (2, "better")}
    gone = c.fold(frames(spark, edit)[0], deleted=F.col("content") == "better").collect()
    assert len(gone) == 1


def test_hot_conversation_in_parts(spark):
    rows = talk(1, ["user", "assistant"] * 400)
    random.Random(1).shuffle(rows)
    parts = c.transcript_parts(c.transcript(*frames(spark, rows))).orderBy("part").collect()
    assert len(parts) == 13 and [t["turn"] for p in parts for t in p["turns"]] == list(range(1, 801)) and max(len(p["turns"]) for p in parts) == 64
    assert parts[0]["turns"][0]["speaker"] == "user"


def test_empty_tables(spark):
    assert dropped(spark, []) == {} and c.transcript(*frames(spark, [])).count() == 0


def test_null_message_ids_are_messages_of_their_own(spark):
    rows = [(None, 1, 1, "user", "x", 1, 0), (None, 1, 2, "assistant", "x", 2, 0)]
    assert dropped(spark, rows) == {}


def test_deletions_are_events(spark):
    rows = [("m1", 1, 1, "user", "hi", 1), ("m2", 1, 2, "assistant", "yes", 2), ("m3", 1, 3, "user", "more", 3), ("m3", 1, 3, "user", "more, edited", 4), ("m4", 2, 1, "user", "x", 5), ("m5", 2, 2, "assistant", "y", 6)]
    m = spark.createDataFrame(rows, "message_id string, conversation_id long, seq long, role string, content string, ingest_seq long")
    ids = spark.createDataFrame([(1,), (2,)], "conversation_id long")
    run = lambda **o: sorted((r["conversation_id"], r["turn"], r["speaker"], r["content"]) for r in c.transcript(m, ids, **o).collect())
    # the last user turn has no answer until it is deleted
    assert run() == [(2, 1, "user", "x"), (2, 2, "assistant", "y")]
    gone = run(deleted=m["message_id"] == "m3")
    assert gone == [(1, 1, "user", "hi"), (1, 2, "assistant", "yes"), (2, 1, "user", "x"), (2, 2, "assistant", "y")]
    assert [r[0] for r in run(deleted=m["message_id"].isin("m3", "m5"))] == [1, 1]


def test_no_setting_of_the_session_is_changed(spark):
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    m = spark.createDataFrame([("m1", 1, 1, "user", "hi", 1), ("m2", 1, 2, "assistant", "yes", 2)], "message_id string, conversation_id long, seq long, role string, content string, ingest_seq long")
    t = c.transcript(m, spark.createDataFrame([(1,)], "conversation_id long"))
    plan = c.transcript_parts(t)._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(name) == before and t.count() == 2 and "REPARTITION_BY_COL" in plan
