import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.functions import embed, times
from thicket.functions import vectors as V
from thicket.operators import drift, feedback, geometry, ingest, keyword, lineage, ranking, retrieval


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(expr.alias("x")).first()["x"]


def test_vector_expressions(spark):
    a, b = [1.0, 2.0, 2.0], [2.0, 1.0, 0.0]
    assert one(spark, V.cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(4 / ((3 + 1e-9) * (math.sqrt(5) + 1e-9)))
    assert one(spark, V.effective_rank(F.col("a")), a=[0.0, 0.0]) == 1.0
    assert one(spark, V.effective_rank(F.col("a")), a=[1.0, 1.0, 1.0, 1.0]) == pytest.approx(4, abs=1e-6)
    assert one(spark, V.anisotropy(F.col("a")), a=[3.0, 1.0]) == pytest.approx(0.75)
    assert one(spark, V.unit(F.col("a")), a=[3.0, 4.0]) == [0.6, 0.8]


def test_usable_vectors(spark):
    rows = [([1.0, 2.0],), ([0.0, 0.0],), ([1.0],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,)]
    df = spark.createDataFrame(rows, "v array<float>")
    assert [r["u"] for r in df.select(V.usable(F.col("v"), 2).alias("u")).collect()] == [True] + [False] * 6


def test_geometry_against_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    w = rng.random(40)
    df = spark.createDataFrame([("b" if i % 2 else "c", x[i].tolist(), float(w[i])) for i in range(40)], "branch_id string, embedding array<float>, importance_score double")
    for r in geometry.branch_geometry(df, 8).collect():
        sel = np.arange(40) % 2 == (1 if r["branch_id"] == "b" else 0)
        xs, ws = x[sel].astype(float), w[sel]
        mu = (ws[:, None] * xs).sum(0) / (ws.sum() + 1e-9)
        var = (ws[:, None] * (xs - mu) ** 2).sum(0) / (ws.sum() + 1e-9)
        cos = xs @ mu / ((np.linalg.norm(xs, axis=1) + 1e-9) * (np.linalg.norm(mu) + 1e-9))
        assert np.allclose(r["mean_vec"], mu) and np.allclose(r["cov_diagonal"], var)
        assert r["coherence"] == pytest.approx((ws * cos).sum() / (ws.sum() + 1e-9))


def test_running_mean_is_the_fold(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(90, 4)).astype(np.float32)
    rows = [("b", f"n{i}", float(i // 3) * 40000, i, x[i].tolist()) for i in range(90)]
    got = ingest.running_mean(spark.createDataFrame(rows, "branch_id string, id string, timestamp double, ingest_seq long, embedding array<float>"), 4).first()
    mu = x[0].astype(float)
    for k in range(2, 91):
        mu = (1 - 0.05 / k) * mu + 0.05 / k * x[k - 1]
    assert got["n"] == 90 and np.allclose(got["mean_vec"], mu, atol=1e-9)


def test_order_and_chains_over_slices_equal_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), f"n{i}", rng.choice([None, rng.random() * 5e5]), i, rng.choice(["refine", "attach", "contradict", "supersede", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "branch_id string, id string, timestamp double, ingest_seq long, update_mode string")
    got = {r["ingest_seq"]: (r["kind"], r["prev_id"], r["root_id"], r["version"]) for r in lineage.correction_chains(df).collect()}
    want, last = {}, {}
    for b, i, t, s, m in sorted((r for r in rows if r[0]), key=lambda r: (r[2] or 0.0, r[3])):
        p = last.get(b)
        if p and m in ("refine", "contradict", "supersede"):
            want[s] = (m, p[0], p[1], p[2] + 1)
            last[b] = (i, p[1], p[2] + 1)
        else:
            want[s] = ("none", None, None, 1)
            last[b] = (i, i, 1)
    assert got == want


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 400), st.integers(2, 60))
def test_even_places_formula(total, target):
    step = (total - 1) / (target - 1)
    taken = [r for r in range(total) if total <= target or math.floor(math.ceil(r / step - 1e-9) * step + 1e-9) == r]
    want = list(range(total)) if total <= target else sorted({math.floor(j * step + 1e-9) for j in range(target)})
    assert taken == want


def test_feedback_closed_form_is_the_fold(spark):
    rng = random.Random(2)
    rows = [(i, f"b{rng.randint(0, 2)}", rng.random() < 0.5, rng.random() < 0.2, False, rng.choice([None, rng.random() * 2 - 0.5]), rng.random() * 1e6) for i in range(400)]
    df = spark.createDataFrame(rows, "seq long, branch_id string, used boolean, corrected boolean, expanded boolean, usefulness_signal double, timestamp double")
    u, e = {}, {}
    for s, b, used, corr, _, sig, t in sorted(rows, key=lambda r: (r[6], r[0])):
        r = min(1, max(0, sig)) if sig is not None else -0.5 if corr else 1.0 if used else 0.0
        u[b] = 0.9 * u.get(b, 0.3) + 0.1 * r
        e[b] = 0.9 * e.get(b, 0.3) + 0.1 * corr
    for r in feedback.usefulness(df, start=0.3).collect():
        assert r["usefulness"] == pytest.approx(u[r["branch_id"]]) and r["retrieval_error"] == pytest.approx(e[r["branch_id"]])


def test_retention_by_age_and_size(spark):
    rows = [(i, "b", float(i * 700)) for i in range(500)]
    df = spark.createDataFrame(rows, "seq long, branch_id string, timestamp double")
    from dataclasses import replace

    kept = feedback.retained(df, 350000.0, replace(Config(), feedback_days=3.0, feedback_rows=120))
    assert sorted(r["seq"] for r in kept.collect()) == list(range(380, 500))


def test_update_modes_of_the_scenario():
    a = np.array([0.10, 0.21, 0.31, 0.42, 0.02, 0.09, 0.19, 0.29])
    b = np.array([0.11, 0.20, 0.30, 0.41, 0.02, 0.10, 0.18, 0.30])
    from dataclasses import replace

    cfg = replace(Config(), refine_sim=0.90, contradict_conflict=0.40, supersede_sim=0.70, supersede_conflict=0.80, supersede_types=("broad_history",))
    f = ingest.Fold(cfg)
    rows = [f.step(1, a, 0, "broad_history", None)]
    branch = rows[0][1]
    rows += [f.step(i, b, c, "broad_history", branch) for i, c in ((2, 0.0), (3, 0.5), (4, 0.9))]
    assert [r[5] for r in rows] == ["fork", "refine", "contradict", "supersede"]
    assert [r[8] for r in rows] == [1, 2, 3, 4] and rows[3][7] == 1


def test_second_item_of_a_cold_branch_forks_and_an_equal_one_attaches():
    f = ingest.Fold()
    x = np.array([0.1, 0.2, 0.3, 0.4])
    assert [f.step(1, x, 0, "default", None)[2], f.step(2, x, 0, "default", None)[2]] == ["fork", "attach"]
    assert f.step(3, x + 0.01, 0, "default", None)[2] == "fork"


def test_two_means_separates_and_split_covers(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (20, 3)) + [1, 0, 0], rng.normal(0, 0.1, (15, 3)) - [1, 0, 0]])
    assert len(set(ingest.two_means(x)[:20])) == 1 and len(set(ingest.two_means(x))) == 2
    df = spark.createDataFrame([("b", i, v.tolist()) for i, v in enumerate(x)], "branch_id string, ingest_seq long, embedding array<float>")
    sizes = sorted(r["count"] for r in ingest.split_branches(df, 3).groupBy("child").count().collect())
    assert sizes == [15, 20]
    assert ingest.two_means(np.ones((5, 2))).tolist().count(0) >= 1


def test_ranks(spark):
    rows = [("a", i % 5) for i in range(200)] + [(None, 1), ("b", 9)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = ranking.bucketed_rank(df, ["g"], ["v"], buckets=7).collect()
    assert sorted(r["rank"] for r in got if r["g"] == "a") == list(range(200)) and len(got) == 202
    t = ranking.tie_rank(spark.createDataFrame([("en", "x", 5), ("en", "y", 5), ("en", "z", 1)], "l string, w string, n long"), ["l"], "n")
    assert {r["w"]: r["rank"] for r in t.collect()} == {"x": 2, "y": 2, "z": 3}


def test_query_terms_and_scores(spark):
    assert keyword.query_terms("The the c++ of RAG-index") == (["the", "c++", "rag-index"], "the c++ rag-index")
    assert keyword.query_terms("ab") == ([], None)
    rows = [(1, "m1", 1, "alpha beta here", 1.0), (1, "m2", 2, "only alpha", 2.0), (2, "m3", 3, "beta " + "x" * 500 + " alpha", 3.0), (3, "m4", 4, None, 4.0)]
    df = spark.createDataFrame(rows, "conversation_id long, message_id string, ingest_seq long, content string, created_at double")
    w = keyword.document_weights(df, ["alpha", "beta"], 3)
    s = {r["conversation_id"]: r for r in keyword.score(keyword.evidence(keyword.matches(df, ["alpha", "beta"], "alpha beta"), ["alpha", "beta"]), ["alpha", "beta"], w, "alpha beta").collect()}
    assert set(s) == {1, 2} and s[1]["score"] > s[2]["score"] and s[2]["part_near"] == pytest.approx(2.5 * 0.45)


def test_times(spark):
    rows = [("1700000000",), ("1700000000000",), ("2024-01-02",), ("2024-01-02T03:04:05Z",), ("soon",), (None,)]
    got = [r["e"] for r in spark.createDataFrame(rows, "t string").select(times.epoch(F.col("t")).alias("e")).collect()]
    assert got == [1.7e9, 1.7e9, 1704153600.0, 1704164645.0, None, None]
    assert times.bounds(1e6, min_age_days=1, max_age_days=2, after=900000.0) == (900000.0, 913600.0)


def test_recency_blend_of_equal_scores(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 1.0, None)], "branch_id string, total double, ts double")
    got = {r["branch_id"]: r for r in retrieval.blend(df, "total", "ts", 0.5, 86400.0 * 14).collect()}
    assert got["a"]["final"] == pytest.approx(0.75) and got["b"]["recency"] == 0.0


def test_hashing_embedding_is_unit_and_deterministic(spark):
    df = spark.createDataFrame([("some text here",), ("some text here",), ("",), (None,)], "t string")
    v = [r["v"] for r in df.select(embed.embed("t", 16).alias("v")).collect()]
    assert v[0] == v[1] and np.linalg.norm(v[0]) == pytest.approx(1, abs=1e-6) and v[2] == [0.0] * 16 and v[3] is None


def test_drift_pairs_are_bounded_and_gapped(spark):
    rows = [("b", f"n{i}", float(i), i, "user", 10, 99, [1.0, 0.0] if i % 2 else [-1.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "branch_id string, id string, timestamp double, ingest_seq long, role string, token_count long, chars long, embedding array<float>")
    p = drift.pairs(drift.sample(df, 192))
    d = drift.density(p).first()
    assert d["eligible"] == sum(1 for i in range(60) for j in range(i + 48, 60)) and d["drifting"] == sum(1 for i in range(60) for j in range(i + 48, 60) if (i + j) % 2)
    assert pd.DataFrame(drift.edges(p).collect()).shape[0] == d["drifting"]


def test_an_item_finds_its_branch_among_the_newest_128_not_only_the_last_ten():
    rng = np.random.default_rng(7)
    e = np.eye(16)
    f = ingest.Fold(forget=True)
    first = f.step(0, e[0], 0, "default", None, 1.0)[1]
    f.step(1, e[0], 0, "default", first, 2.0)
    f.step(2, e[0], 0, "default", first, 3.0)
    for i in range(1, 15):  # fourteen branches touched later, smaller and apart
        f.step(2 + i, 50 * i * e[i] + rng.normal(0, 0.01, 16), 1.0, "default", f"other_{i}", 3.0 + i)
    assert first in f.newest.best(10, None, 20.0)
    got = f.step(99, e[0], 0, "default", None, 20.0)
    assert got[1] == first and got[2] == "attach"


def test_several_branches_scored_at_once_are_scored_as_one_by_one():
    rng, cfg = np.random.default_rng(8), Config()
    a, b = ([ingest.Branch(rng2.normal(size=6)) for _ in range(4)] for rng2 in (np.random.default_rng(9), np.random.default_rng(9)))
    for _ in range(5):
        x, conflict = rng.normal(size=6), float(rng.random())
        assert np.allclose(ingest.strangeness_of(a, x, conflict, cfg), [s.strangeness(x, conflict, cfg) for s in b])
        assert all(np.allclose(list(p.ema.values()), list(q.ema.values())) for p, q in zip(a, b))


def test_forgotten_branches_change_nothing():
    rng = np.random.default_rng(10)
    xs = [rng.normal(size=4) * 10.0 ** rng.integers(-1, 3) for _ in range(600)]
    keep, drop = ingest.Fold(newest=12), ingest.Fold(newest=12, forget=True)
    assert [keep.step(i, x, 1.0, "default", None, float(i)) for i, x in enumerate(xs)] == [drop.step(i, x, 1.0, "default", None, float(i)) for i, x in enumerate(xs)]
    assert len(drop.branches) <= 12 < len(keep.branches)


def test_free_allocation_takes_every_usable_node(spark):
    import os

    from thicket.plans import evolution
    from thicket.plans.branches import DIM, nodes

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    usable = nodes(spark, folder).where(V.usable(F.col("embedding"), DIM)).select("ingest_seq")
    assert evolution.free_allocation(spark, folder).count() == usable.count()


def test_long_branches_are_split_by_all_their_vectors(spark):
    rng = np.random.default_rng(12)
    rows = []
    for b, n in (("a", 400), ("b", 90), ("same", 20), ("short", 5)):
        x = rng.normal(size=(n, 3)) if b != "same" else np.ones((n, 3))
        rows += [(b, 1000 * ord(b[0]) + i, v.tolist()) for i, v in enumerate(x)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(b, int(i), list(map(float, v))) for b, i, v in rows], "branch_id string, ingest_seq long, embedding array<float>")
    want = {tuple(r) for r in ingest.split_branches(df, 3).collect()}
    for most in (10, 100):
        assert {tuple(r) for r in ingest.split_branches(df, 3, most=most).collect()} == want


def test_settings_from_file_and_environment(tmp_path):
    from thicket import config

    f = tmp_path / "c.json"
    f.write_text('{"refine_sim": 0.8, "mode_state": {"balanced": {"DORMANT": 0.5}}, "excluded_states": ["X"]}')
    c = config.load(str(f), '{"refine_sim": 0.7}')
    assert c.refine_sim == 0.7 and c.mode_state["balanced"]["DORMANT"] == 0.5 and c.mode_state["balanced"]["FORMING"] == 0.90 and c.excluded_states == ("X",)
    assert config.load(str(tmp_path / "none.json"), " ") == Config() and config.load(None, "not json") == Config()
    with pytest.raises(KeyError):
        config.load(None, '{"nothing": 1}')


def test_signatures_of_models():
    a = embed.guard(None, {"backend": "GGUF", "model_path": "/m/x.gguf", "dim": "64"})
    assert embed.guard(a, {"backend": "llama-cpp", "model_name": "/other/x.gguf", "model_path": "/m/x.gguf", "dim": 64}) == a
    with pytest.raises(embed.OtherModel):
        embed.guard(a, {"backend": "http", "dim": 64})
    assert embed.guard(a, {"backend": "http", "dim": "x"}, allow=True) != a
    assert embed.dimension(embed.hashing_provider(24)) == 24


def test_all_limits_of_time():
    day = 86400.0
    assert times.bounds(100 * day, within_days=3) == (97 * day, None) and times.bounds(100 * day, max_age_days=2, within_days=3)[0] == 98 * day
    assert times.bounds(0.0, date_from="2024-01-02", date_to="2024-01-02") == (1704153600.0, 1704153600.0 + day - 0.001)
    assert times.bounds(0.0, date_to="2024-01-02T01:00:00Z")[1] == 1704157200.0 and times.bounds(1e9, max_age_days=-1, min_age_days=-1) == (None, None)
    assert times.bounds(0.0, after="1700000000000", before="soon") == (1.7e9, None)


def test_snippets_warnings_and_encodings(spark):
    from thicket.functions import codec

    df = spark.createDataFrame([("a  b\n\u00a0c",), ("x" * 39 + " " + "y" * 300,), (None,)], "t string")
    assert [r[0] for r in df.select(keyword.one_line(F.col("t"), 41)).collect()] == ["a b c", "x" * 39 + "...", ""]
    assert spark.range(1).select(keyword.warnings(F.lit("a"), F.lit(None).cast("string"), F.lit("b"), F.lit("a"))).first()[0] == "a; b"
    rows = spark.createDataFrame([("[1.5, -2]",), ("not json",), (None,), ("",)], "t string").select(codec.vector_of(F.col("t")).alias("v"), codec.payload(F.col("t"), "k long")["k"].alias("k")).collect()
    assert [r["v"] for r in rows] == [[1.5, -2.0], [], [], []] and all(r["k"] is None for r in rows)


def test_branches_that_collapse_are_ranked_apart(spark):
    rows = [("a", "COLLAPSING", 5, [1.0, 0.0]), ("b", "COLLAPSING", 5, [0.0, 1.0]), ("c", "COLLAPSING", 0, [1.0, 0.0]), ("d", "STABLE", 9, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "branch_id string, state string, node_count long, mean_vec array<double>").withColumns({c: F.lit(0.5) for c in ("coherence", "compression_loss", "topic_drift_density", "retrieval_error")})
    df = df.withColumns({"regime": F.lit("RIGID"), "branch_type": F.lit("x")})
    got = retrieval.score(df.where("state = 'COLLAPSING' AND node_count > 0"), [1.0, 0.0]).orderBy(F.col("total").desc()).collect()
    assert [r["branch_id"] for r in got] == ["a", "b"] and retrieval.ranking(df, [1.0, 0.0]).count() == 1


def test_links_to_removed_copies_are_led_to_the_ones_that_stay(spark):
    from thicket.operators import integrity

    rows = [(1, "a", None, None, None), (2, "b", None, None, None), (3, "c", "b", "b", "b"), (4, "d", "a", None, "c")]
    n = spark.createDataFrame(rows, "ingest_seq long, id string, parent_id string, correction_prev_id string, correction_root_id string")
    dup = spark.createDataFrame([(2, "b", "a")], "ingest_seq long, id string, keep_id string")
    assert [tuple(r) for r in integrity.rewire(n, dup).collect()] == [(3, "c", "a", "a", "a")]


@pytest.mark.parametrize("slice_items, short", [(7, 0), (60, 0), (100_000, 0), (60, 100), (60, 10_000)])
def test_forced_fold_in_slices_is_the_fold_item_by_item(spark, slice_items, short):
    rng = np.random.default_rng(21)
    rows = []
    for i in range(400):
        b = rng.choice(["a", "b", "c", None], p=[0.6, 0.3, 0.05, 0.05])
        x = np.ones(5) if rng.random() < 0.2 else rng.normal(size=5) + 2 * (i % 3 == 0)
        rows.append((i * 3, b, x.tolist(), float(rng.choice([0.0, 0.1, 0.5, 0.9])), "preference" if b == "b" else "default"))
    shuffled = [rows[i] for i in rng.permutation(len(rows))]
    df = spark.createDataFrame([(i, None if b is None else str(b), x, c, t) for i, b, x, c, t in shuffled], "item long, forced_branch string, x array<double>, conflict double, branch_type string")
    got = {r["item"]: tuple(r) for r in ingest.forced_fold(df, slice_items=slice_items, short=short).collect()}
    folds, n = {}, 0
    for i, b, x, c, t in rows:
        if b is None:
            assert i not in got
            continue
        want = folds.setdefault(b, ingest.Fold()).step(i, np.array(x), c, t, str(b))
        n += 1
        have = got[i]
        assert have[:3] == want[:3] and have[5:9] == want[5:9], (have, want)
        assert have[3] == pytest.approx(want[3], rel=1e-6, abs=1e-9) and have[4] == pytest.approx(want[4], abs=1e-9) and have[9] == pytest.approx(want[9], abs=1e-9)
    assert len(got) == n


def test_http_provider_with_a_service_that_fails_at_first():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    calls = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            calls.append(texts)
            self.send_response(503 if len(calls) == 1 else 400 if texts == ["bad"] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"data": [{"embedding": [len(t), 1.0]} for t in texts]} if len(calls) < 3 else {"embeddings": [[len(t), 2.0] for t in texts]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        f = embed.http_provider(f"http://127.0.0.1:{server.server_port}/embeddings", wait=0.01)
        assert f(["ab", "c"]).tolist() == [[2.0, 1.0], [1.0, 1.0]] and len(calls) == 2
        assert f(["xyz"]).tolist() == [[3.0, 2.0]] and embed.dimension(f) == 2
        n = len(calls)
        with pytest.raises(Exception):
            f(["bad"])
        assert len(calls) == n + 1
    finally:
        server.shutdown()


def test_states_that_a_request_names():
    assert retrieval.state_list(" active, Stable,ACTIVE ") == ["ACTIVE", "STABLE"] and retrieval.state_list("ALL") is None and retrieval.state_list(["*"], "working") == ["FORMING", "ACTIVE", "REACTIVATING"]
    assert retrieval.state_list(None, " Settled") == ["STABLE"] and retrieval.state_list(None, "none") is None
