import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import neighbours as nb

SCHEMA = "id string, vec array<float>, seq long, block long, cosine string"


def frame(spark, x, ids=None):
    ids = ids or [f"n{i:05d}" for i in range(len(x))]
    return spark.createDataFrame([(i, None if v is None else [None if u is None else float(u) for u in v], s, 0, "x") for s, (i, v) in enumerate(zip(ids, x))], SCHEMA)


def exact(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def clustered(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 64))
    return (centres[rng.integers(0, 30, n)] + rng.normal(size=(n, 64))).astype(np.float32)


def test_recall_against_brute_force(spark):
    x = clustered(3000)
    _, top = exact(x, 10)
    got = nb.neighbours(frame(spark, x), "id", "vec", "seq", probes=12, list_rows=100, block_rows=500).toPandas()
    sets = {q: set(g) for q, g in got.groupby("q")["id"]}
    recall = np.mean([len(sets[f"n{i:05d}"] & {f"n{j:05d}" for j in top[i]}) / 10 for i in range(len(x))])
    assert recall >= 0.9 and got.groupby("q").size().eq(10).all()
    assert (got.sort_values(["q", "place"]).groupby("q")["cosine"].diff().dropna() <= 1e-12).all()


@pytest.mark.parametrize("cells, block_rows", [(10, 150), (15, 40), (40, 60)])
def test_recall_with_fine_centroids_and_bounded_copies(spark, cells, block_rows):
    x = clustered(3000)
    _, top = exact(x, 10)
    got = nb.neighbours(frame(spark, x), "id", "vec", "seq", probes=30, list_rows=50, block_rows=block_rows, cells=cells).toPandas()
    sets = {q: set(g) for q, g in got.groupby("q")["id"]}
    recall = np.mean([len(sets[f"n{i:05d}"] & {f"n{j:05d}" for j in top[i]}) / 10 for i in range(len(x))])
    assert recall >= 0.9 and got.groupby("q").size().eq(10).all()


def test_copies_of_a_query_do_not_grow_with_the_vectors():
    x = clustered(4000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = nb.Model(x, 4096, 16, cells=16)
    assert len(m.centroids) == 16 and len(m.fine) == 256
    import pandas as pd

    pdf = pd.DataFrame({"id": [str(i) for i in range(200)], "seq": range(200), "asked": True, "vec": list(x[:200])})
    copies = []
    for blocks in (1, 8, 64, 256):
        out = next(nb._route(m, 12, nb.Layout(m, np.full(len(m.load), blocks)))(iter([pdf])))
        assert out["stored"].sum() == 200
        copies.append((~out["stored"]).sum() / 200)
    assert max(copies) <= 12
    # a list longer than a block lies in several, and all are visited
    out = next(nb._route(m, 12, nb.Layout(m, np.full(len(m.load), 1024)))(iter([pdf])))
    assert (~out["stored"]).sum() / 200 <= 4 * 12


def test_more_close_vectors_than_any_short_list(spark):
    rng = np.random.default_rng(6)
    x = clustered(600)
    x[:400] = x[0] + rng.normal(size=(400, 64)) * 0.02
    near = nb.neighbours(frame(spark, x), "id", "vec", "seq", probes=2, min_cosine=0.95, rerank=1).toPandas()
    s, top = exact(x.astype(float), 10)
    for i in range(0, 400, 37):
        assert set(near[near["q"] == f"n{i:05d}"]["id"]) == {f"n{j:05d}" for j in top[i]}


SF = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_of_the_registered_queries_on_the_tables(spark):
    from thicket.functions.keys import key
    from thicket.llm import queries

    n = spark.read.parquet(f"{SF}/memory_nodes.parquet").select(key("id").alias("id"), "ingest_seq", "embedding")
    n = n.where("id IS NOT NULL").where(nb.usable(F.col("embedding"), 64)).toPandas().sort_values("ingest_seq")
    asked = set(n[n["ingest_seq"] % 20 == 0]["id"])
    first = n.drop_duplicates("id")
    ids, x = first["id"].to_numpy(), nb._unit(first["embedding"])
    rows = np.flatnonzero(first["id"].isin(asked).to_numpy())
    got = {q: set(g) for q, g in queries.p3_neighbours(spark, SF).toPandas().groupby("q")["id"]}
    hits, of, close, found = 0, 0, 0, 0
    pairs = {tuple(r) for r in queries.p3_found(spark, SF).collect()}
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        s = x[part] @ x.T
        s[np.arange(len(part)), part] = -9
        top = np.argpartition(-s, 10, axis=1)[:, :10]
        for i, t, sims in zip(part, top, s):
            worst = sims[t].min()
            mine = [j for j in np.flatnonzero(sims >= worst - 1e-6) if ids[j] in got[ids[i]]]
            hits, of = hits + min(10, len(mine)), of + 10
            for j in t:
                if sims[j] >= 0.9500001:
                    back = x @ x[j]
                    back[j] = -9
                    if (back > sims[j] + 1e-7).sum() < 10 and (sims > sims[j] + 1e-7).sum() < 10 and (back >= sims[j] - 1e-7).sum() <= 10 and (sims >= sims[j] - 1e-7).sum() <= 10:
                        close += 1
                        found += tuple(sorted((ids[i], ids[j]))) in pairs
    print("recall", hits / of, "pairs", found, close)
    assert hits / of >= 0.9 and found / close >= 0.98


def test_close_pairs_are_found_from_both_sides(spark):
    x = clustered(2000)
    rng = np.random.default_rng(5)
    x[1000:1300] = x[:300] + rng.normal(size=(300, 64)).astype(np.float32) * 0.15
    near = nb.neighbours(frame(spark, x), "id", "vec", "seq", probes=2, min_cosine=0.95, list_rows=100, block_rows=400)
    got = {tuple(r) for r in nb.mutual(near, 0.95).collect()}
    s, top = exact(x.astype(float), 10)
    want = {(f"n{i:05d}", f"n{j:05d}") for i in range(2000) for j in top[i] if i < j and s[i, j] >= 0.95 and i in top[j]}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 250


def test_unusable_repeated_and_few_vectors(spark):
    good = np.eye(64, dtype=np.float32)[:3] + 0.1
    rows = [*good, None, good[0][:32], np.zeros(64), [float("nan")] * 64, [float("inf")] * 64, [None] * 64, good[0]]
    ids = ["a", "b", "c", "d", "e", "f", "g", "h", "i", " A"]
    got = nb.neighbours(frame(spark, rows, ids), "id", "vec", "seq", probes=4).toPandas()
    assert set(got["q"]) == {"a", "b", "c"} and len(got) == 6 and not (got["q"] == got["id"]).any()
    assert nb.neighbours(frame(spark, [], []), "id", "vec", "seq").count() == 0
    assert nb.neighbours(frame(spark, good[:1], ["a"]), "id", "vec", "seq").count() == 0


def test_a_vector_that_a_third_of_the_rows_share(spark):
    x = clustered(900)
    x[::3] = x[0]
    near = nb.neighbours(frame(spark, x), "id", "vec", "seq", probes=4, min_cosine=0.95, list_rows=100, block_rows=200).toPandas()
    hot = near[near["q"].isin([f"n{i:05d}" for i in range(0, 900, 3)])]
    assert hot.groupby("q").size().eq(10).all() and len(hot["q"].unique()) == 300
    first = [f"n{i:05d}" for i in range(0, 36, 3)]
    for q, g in hot.groupby("q"):
        assert set(g["id"]) == set([i for i in first if i != q][:10])


def test_queries_restrict_who_asks_not_what_is_indexed(spark):
    x = clustered(400)
    got = nb.neighbours(frame(spark, x), "id", "vec", "seq", probes=4, list_rows=50, queries=F.col("seq") % 20 == 0).toPandas()
    assert set(got["q"]) == {f"n{i:05d}" for i in range(0, 400, 20)} and len(set(got["id"])) > 100


def test_approximate_similarity_is_near_the_exact_one():
    x = clustered(2000)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    m = nb.Model(x, 16, 4)
    at = nb._nearest(x, m.centroids, True)
    codes, q = m.codes(x, at), x[:50]
    approx = q @ m.centroids[at].T + sum(np.take(m.tables(q)[:, p], codes[:, p], axis=1) for p in range(m.parts))
    assert np.abs(approx - q @ x.T).max() < 0.3 and np.corrcoef(approx.ravel(), (q @ x.T).ravel())[0, 1] == pytest.approx(1, abs=0.05)
