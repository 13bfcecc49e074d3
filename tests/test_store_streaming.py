from pyspark.sql import functions as F

from thicket.sources.store import Store, conform
from thicket.streaming import poll


def rows(spark, items):
    return spark.createDataFrame(items, poll.MESSAGES)


def test_store_upsert_patch_delete_vacuum(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    mk = lambda x: spark.createDataFrame(x, "k long, v string, t long")
    s.upsert("t", mk([(1, "a", 1), (1, "b", 2), (2, "c", 1)]), ["k"], F.col("t"))
    s.upsert("t", mk([(2, "d", 5), (3, "e", 5)]), ["k"], F.col("t"))
    assert {(r["k"], r["v"]) for r in s.read("t").collect()} == {(1, "b"), (2, "d"), (3, "e")}
    s.patch("t", spark.createDataFrame([(1, "z"), (2, None)], "k long, v string"), ["k"])
    s.delete("t", spark.createDataFrame([(3,)], "k long"), ["k"])
    assert {(r["k"], r["v"]) for r in s.read("t").collect()} == {(1, "z"), (2, "d")}
    assert s.vacuum("t") == 3 and s.read("t").count() == 2 and s.read("none") is None


def test_conform_adds_columns(spark):
    df = conform(spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([], "k long, x double, y string").schema, {"x": 0.5})
    assert tuple(df.first()) == (1, 0.5, None)


def test_poll_is_idempotent_and_keeps_dead_letters(spark, tmp_path):
    src, store = str(tmp_path / "src"), Store(spark, str(tmp_path / "store"))
    first = [("m1", 1, 1, "user", "hello", 2, 1.0, 1), ("m2", 1, 2, "assistant", "hi", 2, 2.0, 2), ("M1 ", 1, 1, "user", "hello", 2, 1.0, 3), (None, 1, 3, "user", "x", 1, 3.0, 4)]
    rows(spark, first).coalesce(1).write.parquet(src)
    poll.poll(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    assert {r["message_id"] for r in store.read("messages").collect()} == {"m1", "m2"} and store.read("dead_letter").count() == 1
    rows(spark, [("m2", 1, 2, "assistant", "hi", 2, 2.0, 5), ("m3", 2, 1, "user", "y", 1, 3.0, 6)]).coalesce(1).write.mode("append").parquet(src)
    poll.poll(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    # a second stream from the start replays everything and adds nothing
    poll.poll(spark, src, store, str(tmp_path / "cp2")).awaitTermination()
    assert sorted(r["message_id"] for r in store.read("messages").collect()) == ["m1", "m2", "m3"]
    assert store.read("polls").agg(F.max("last_seq")).first()[0] == 6


def test_windows_on_a_table(spark):
    df = rows(spark, [("a", 1, 1, "user", "x", 3, 10.0, 1), ("b", 1, 2, "user", "x", 4, 3000.0, 2), ("c", 1, 3, "user", "x", 5, 4000.0, 3)])
    got = {(r["window_start"], r["messages"], r["tokens"]) for r in poll.activity_windows(df).collect()}
    assert got == {(0, 2, 7), (3600, 1, 5)}


def test_an_upsert_of_one_key_rewrites_one_bucket(spark, tmp_path):
    s = Store(spark, str(tmp_path), buckets=8)
    s.upsert("t", spark.range(200).selectExpr("id AS k", "'a' AS v"), ["k"])
    before = set(s.current("t"))
    s.upsert("t", spark.createDataFrame([(7, "b")], "k long, v string"), ["k"])
    after = set(s.current("t"))
    assert len(before) == 8 and len(before - after) == 1 and len(after - before) == 1
    assert s.read("t").count() == 200 and s.read("t").where("v = 'b'").collect()[0]["k"] == 7
    s.append("t", spark.createDataFrame([(7, "c"), (900, "c")], "k long, v string"))
    assert s.read("t").count() == 202
    assert {r["v"] for r in s.near("t", spark.createDataFrame([(7,)], "k long"), ["k"]).where("k = 7").collect()} == {"b", "c"}
    s.delete("t", spark.createDataFrame([(7,)], "k int"), ["k"])  # another number type, the same bucket
    assert s.read("t").count() == 200
    s.upsert("t", spark.createDataFrame([("a", 1)], "v string, k long"), ["v"])  # other keys: written anew
    assert s.read("t").where("v = 'a'").count() == 1


def test_a_crash_between_the_steps_of_the_pointer_leaves_the_table_readable(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path))
    one = spark.createDataFrame([(1, "a")], "k long, v string")
    s.upsert("t", one, ["k"])
    for step in ("create", "rename"):
        real = Store._path

        class Broken:
            def __init__(self, fs):
                self.fs = fs

            def __getattr__(self, name):
                if name == step:
                    raise OSError("crash")
                return getattr(self.fs, name)

        def path(self, p):
            x, fs = real(self, p)
            return x, Broken(fs) if "/w-" in p else fs

        monkeypatch.setattr(Store, "_path", path)
        try:
            s.upsert("t", spark.createDataFrame([(1, "z")], "k long, v string"), ["k"])
            raise AssertionError("no crash")
        except OSError:
            pass
        monkeypatch.setattr(Store, "_path", real)
        assert [r["v"] for r in s.read("t").collect()] == ["a"]
    s.upsert("t", spark.createDataFrame([(1, "y")], "k long, v string"), ["k"])
    assert [r["v"] for r in s.read("t").collect()] == ["y"]


def test_two_writers_and_both_changes_stay(spark, tmp_path):
    a = Store(spark, str(tmp_path))
    a.upsert("t", spark.createDataFrame([(1, "a")], "k long, v string"), ["k"])
    b, real = Store(spark, str(tmp_path)), Store._state
    calls = []

    def late(self, name):  # another writer comes between reading the state and pointing to the next
        out = real(self, name)
        if self is b and not calls:
            calls.append(1)
            a.append("t", spark.createDataFrame([(2, "b")], "k long, v string"))
        return out

    Store._state = late
    try:
        b.upsert("t", spark.createDataFrame([(3, "c")], "k long, v string"), ["k"])
    finally:
        Store._state = real
    assert sorted(r["k"] for r in a.read("t").collect()) == [1, 2, 3]


def test_patch_can_set_nulls(spark, tmp_path):
    s = Store(spark, str(tmp_path))
    s.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"])
    s.patch("t", spark.createDataFrame([(1, None)], "k long, v string"), ["k"], nulls=True)
    assert {(r["k"], r["v"]) for r in s.read("t").collect()} == {(1, None), (2, "b")}


def test_lag(spark, tmp_path):
    src, store = str(tmp_path / "src"), Store(spark, str(tmp_path / "store"))
    rows(spark, [("m1", 1, 1, "user", "hello", 2, 1.0, 7)]).write.parquet(src)
    assert poll.lag(spark, src, store) == 7
    poll.poll(spark, src, store, str(tmp_path / "cp")).awaitTermination()
    assert poll.lag(spark, src, store) == 0


def test_backup_and_restore(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"))
    s.upsert("t", spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), ["k"])
    assert s.backup("t", str(tmp_path / "b")) == 2 and s.backup("none", str(tmp_path / "b")) == 0
    s.delete("t", spark.createDataFrame([(1,)], "k long"), ["k"])
    s.restore("t", str(tmp_path / "b"))
    assert s.read("t").count() == 2
