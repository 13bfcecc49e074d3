from thicket.operators import orphans


def test_live_needs_a_row_later_than_the_purge(spark):
    rec = spark.createDataFrame([("A", 1.0), ("a ", 5.0), ("b", 1.0), ("c", None), (None, 1.0), ("d", 2.0)], "id string, ts double")
    purge = spark.createDataFrame([("T", "a", 3.0), ("t", "B", 1.0), ("t", "c", 0.0), ("other", "d", 9.0)], "record_table string, record_key string, purged_ts double")
    assert {r["key"] for r in orphans.live(rec, "id", "ts", purge, "t").collect()} == {"a", "d"}


def test_direct_counts_each_row_and_ignores_null(spark):
    refs = spark.createDataFrame([("t", "x", 1, "r"), ("t", "x", 2, "r"), ("t", "y", 3, "r"), ("u", "x", 4, "r"), ("t", None, 5, "r")], "target string, key string, row_seq long, ref string")
    rec = spark.createDataFrame([("u", "x"), ("t", "y")], "target string, key string")
    assert {r["row_seq"] for r in orphans.direct(refs, rec).collect()} == {1, 2}
    assert orphans.direct(refs.limit(0), rec).count() == 0
    assert {r["row_seq"] for r in orphans.direct(refs, rec.limit(0)).collect()} == {1, 2, 3, 4}


def test_hot_missing_key(spark):
    refs = spark.createDataFrame([("t", "gone", i) for i in range(3000)] + [("t", "ok", 9999)], "target string, key string, row_seq long")
    rec = spark.createDataFrame([("t", "ok")], "target string, key string")
    assert orphans.direct(refs, rec).count() == 3000


def test_cascade_reaches_any_depth_and_ends_on_circles(spark):
    rows = [(f"n{i}", f"n{i - 1}" if i else None) for i in range(70)] + [("a", "b"), ("b", "a"), ("c", "c"), ("d", "a"), ("e", "missing")]
    rec = spark.createDataFrame(rows, "key string, parent string")
    bad = spark.createDataFrame([("n3",), ("n10",), ("b",), ("b",)], "key string")
    got = {r["key"]: r["levels"] for r in orphans.cascade(rec, bad).collect()}
    want = {f"n{i}": (i - 3 if i < 10 else i - 10) for i in range(3, 70)} | {"b": 0, "a": 1, "d": 2}
    assert got == want
    assert orphans.cascade(rec, bad.limit(0)).count() == 0


def test_fixpoint_along_several_keys_against_brute_force(spark):
    import random

    rng = random.Random(8)
    keys = [f"k{i}" for i in range(120)]
    up = {n: {k: rng.choice(keys) for k in keys if rng.random() < 0.5} for n in ("a", "b", "c")}
    begin = {"k3", "k77", "outside"}
    up["c"]["k5"] = "outside"
    bad = set(begin)
    while True:
        more = {k for n in up for k, p in up[n].items() if p in bad} - bad
        if not more:
            break
        bad |= more
    frame = lambda d: spark.createDataFrame(list(d.items()), "key string, parent string")
    got = {r["key"]: r["via"] for r in orphans.fixpoint(spark.createDataFrame([(k,) for k in begin], "key string"), {n: frame(d) for n, d in up.items()}).collect()}
    assert set(got) == bad and {k for k, v in got.items() if v == "direct"} == begin
    assert orphans.fixpoint(spark.createDataFrame([], "key string"), {"a": frame(up["a"])}).count() == 0


def test_a_parent_of_most_records_is_split(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT", 100)
    rows = [("root", None), ("hub", "root")] + [(f"c{i}", "hub") for i in range(2000)] + [(f"d{i}", f"c{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "key string, parent string")
    got = {r["key"]: r["levels"] for r in orphans.cascade(df, spark.createDataFrame([("root",)], "key string")).collect()}
    assert len(got) == 2052 and got["root"] == 0 and got["hub"] == 1 and got["c5"] == 2 and got["d7"] == 3
