from collections import Counter

from pyspark.sql import functions as F

from thicket.operators import skew


def test_plan_covers_every_heavy_shard_and_balances(spark):
    rows = [("hot", i) for i in range(3000)] + [(f"k{i % 700}", i) for i in range(3000)] + [(None, 1)] * 50
    df = spark.createDataFrame(rows, "k string, v long")
    plan = skew.plan_tasks(df, "k", tasks=8)
    heavy = {r["key"]: r for r in plan.heavy.collect()}
    assert set(heavy) == {"hot"} and heavy["hot"]["load"] == 3000 and heavy["hot"]["shards"] > 8
    load = Counter()
    for r in plan.slots.collect():
        if r["_sk"] == "hot":
            load[r["task"]] += 3000 / heavy["hot"]["shards"]
    assert max(load.values()) < 3000 / 4


def test_per_key_equals_plain_join_and_group(spark):
    rows = [(1 if i % 3 else i, i, "x") for i in range(2000)] + [(None, 7, "x"), (1, None, None)]
    df = spark.createDataFrame(rows, "k long, v long, load string")
    side = spark.createDataFrame([(1, 10), (1, 20), (3, 5), (99999, 1), (None, 2)], "k long, w long")
    got = skew.per_key(df, "k", {"n": F.count(F.lit(1)), "s": F.sum(F.col("v") * F.col("w"))}, {"n": F.sum("n"), "s": F.sum("s")}, match=side)
    want = df.where("k IS NOT NULL").join(side, "k", "left").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("v") * F.col("w")).alias("s"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_the_join_reuses_the_placement(spark):
    df = spark.range(5000).select((F.col("id") % 7).alias("k"), "id")
    side = spark.range(7).select(F.col("id").alias("k"), F.lit(1).alias("w"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = skew.per_key(df, "k", {"n": F.sum("w")}, {"n": F.sum("n")}, match=side)
        plan = got._jdf.queryExecution().executedPlan().toString()
        # one placement of both sides and the exchange that combines shards
        assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning") == 2, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_empty_and_all_one_key(spark):
    empty = spark.createDataFrame([], "k string, v long")
    assert skew.per_key(empty, "k", {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).count() == 0
    assert skew.dominant(empty, "k").count() == 0
    one = spark.createDataFrame([("a", 1)] * 500, "k string, v long")
    assert [tuple(r) for r in skew.per_key(one, "k", {"n": F.count(F.lit(1))}, {"n": F.sum("n")}).collect()] == [("a", 500)]


def test_dominant_counts_null_rows_in_the_total(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)] * 95, "k string")
    assert [r["key"] for r in skew.dominant(df, "k").collect()] == ["a"]


def test_skew_join_keeps_semantics(spark):
    left = spark.createDataFrame([("h", i) for i in range(300)] + [("l", 1), (None, 2)], "k string, v long")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("m", 3)], "k string, w long")
    heavy = spark.createDataFrame([("h",)], "key string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        got = skew.skew_join(left, right, "k", how, heavy)
        assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k", how).collect())), how
