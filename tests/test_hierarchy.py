import random

from pyspark.sql import functions as F

from thicket.operators import hierarchy


def brute(parent):
    out = {}
    for v in parent:
        path, x, seen = [v], v, {v: 0}
        while parent[x] is not None and parent[x] not in seen:
            x = parent[x]
            seen[x] = len(path)
            path.append(x)
        if parent[x] is None:
            out[v] = (path[-1], len(path) - 1, "root", False, path[::-1])
        else:
            out[v] = (None, None, "cycle", seen[parent[x]] == 0, None)
    return out


def sizes(parent):
    """Descendants of every node, itself included, by walking up from each."""
    below = {v: {v} for v in parent}
    for v in parent:
        x, seen = parent[v], {v}
        while x is not None and x not in seen:
            below[x].add(v)
            seen.add(x)
            x = parent[x]
    return {v: len(s) for v, s in below.items()}


def check(spark, parent, finish=0):
    rows = [(v, p, False) for v, p in parent.items()]
    got = hierarchy.contract(spark.createDataFrame(rows, "nid long, pid long, dangling boolean"), with_paths=True, finish=finish).collect()
    want, size = brute(parent), sizes(parent)
    assert len(got) == len(parent)
    for r in got:
        root, depth, end, cyc, path = want[r["nid"]]
        assert (r["end"], r["on_cycle"], r["size"]) == (end, cyc, size[r["nid"]]), (r, want[r["nid"]])
        assert r["path"][-1] == r["nid"] and len(r["path"]) == r["depth"] + 1
        assert all(parent[b] == a for a, b in zip(r["path"], r["path"][1:]))
        if end == "root":
            assert (r["root"], r["depth"], r["path"]) == (root, depth, path)


def test_random_forests_with_circles(spark):
    rng = random.Random(3)
    parent = {}
    for v in range(400):
        parent[v] = None if rng.random() < 0.05 else rng.randint(max(0, v - 8), v - 1) if v and rng.random() < 0.95 else rng.randint(0, 399)
    check(spark, parent)
    check(spark, parent, finish=150)
    check(spark, parent, finish=10_000)


def test_long_chain_star_and_circles(spark):
    parent = {i: i - 1 if i else None for i in range(300)}
    parent |= {1000 + i: 1000 + (i + 1) % 50 for i in range(50)}
    parent |= {2000: 2000, 2001: 2000, 2002: 2001, 3000: 3001, 3001: 3000}
    parent |= {4000 + i: 4000 if i else None for i in range(500)}
    check(spark, parent)
    check(spark, parent, finish=10_000)


def test_a_chain_and_a_star_of_100000(spark, monkeypatch):
    n = 100_000
    ids = spark.range(n).select("id")
    chain = ids.select(F.col("id").alias("nid"), F.when(F.col("id") > 0, F.col("id") - 1).alias("pid"), F.lit(False).alias("dangling"))
    star = ids.select((F.col("id") + n).alias("nid"), F.when(F.col("id") > 0, F.lit(n)).cast("long").alias("pid"), F.lit(False).alias("dangling"))
    out = hierarchy.contract(chain.unionByName(star))
    bad = out.where(
        F.when(F.col("nid") < n, (F.col("depth") != F.col("nid")) | (F.col("root") != 0) | (F.col("size") != n - F.col("nid")))
        .otherwise((F.col("root") != n) | (F.col("depth") != (F.col("nid") > n).cast("long")) | (F.col("size") != F.when(F.col("nid") == n, n).otherwise(1)))
    )
    assert out.count() == 2 * n and bad.count() == 0
    # the joins by parent deal the star to several tasks
    seen = []
    real = hierarchy._split_join
    monkeypatch.setattr(hierarchy, "_split_join", lambda *a: seen.append(a[-1]) or real(*a))
    assert hierarchy.contract(star).where("root = 100000").count() == n and seen and all(h == [n] for h in seen)


def test_numbering_dangling_repeats_and_empty(spark):
    rows = [("a", "A ", 1, None), ("a", "a", 2, "zz"), ("b", "b", 3, "a"), ("c", "c", 4, "gone"), (None, None, 5, "a"), ("d", "d", 6, "c")]
    nodes = hierarchy.number_nodes(spark.createDataFrame(rows, "key string, id string, seq long, parent string"), ["parent"])
    got = {r["nid"]: r for r in hierarchy.contract(hierarchy.link_edges(nodes, "parent")).collect()}
    assert {n: (r["root"], r["depth"], r["end"]) for n, r in got.items()} == {1: (1, 0, "root"), 3: (1, 1, "root"), 4: (4, 0, "dangling"), 6: (4, 1, "dangling")}
    empty = spark.createDataFrame([], "nid long, pid long, dangling boolean")
    assert hierarchy.contract(empty).count() == 0


def test_descendants(spark):
    p = spark.createDataFrame([(1, [1]), (2, [1, 2]), (3, [1, 2, 3])], "nid long, path array<long>")
    assert {tuple(r) for r in hierarchy.descendants(p).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}


def test_descendants_of_whole_circles(spark):
    rng = random.Random(4)
    parent = {v: None if rng.random() < 0.05 else rng.randint(0, 59) for v in range(60)}
    parent |= {100: 101, 101: 102, 102: 100, 103: 101, 104: 103, 105: 100, 200: 200, 201: 200}
    want = set()
    for v in parent:
        x, hops, seen = parent[v], 1, {v}
        while x is not None and x not in seen:
            want.add((x, v, hops))
            seen.add(x)
            x, hops = parent[x], hops + 1
    rows = spark.createDataFrame([(v, p, False) for v, p in parent.items()], "nid long, pid long, dangling boolean")
    placed = hierarchy.contract(rows, with_paths=True).select("nid", "path", "on_cycle").withColumn("correction", F.lit(False))
    got = [(r["ancestor"], r["nid"], r["distance"]) for r in hierarchy.descendants(placed).collect()]
    assert len(got) == len(set(got)) and set(got) == want
