import math
import random

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from thicket.llm import mixing, packing, tokens

PROFILES = [("s", 100), ("m", 1000)]


def packed(spark, sizes, steps=packing.STEPS):
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)], "doc_id long, tokens long, number long")
    prof = spark.createDataFrame(PROFILES, "profile string, capacity_tokens int")
    return packing.pack(df, prof, steps), prof


def check(pdf, sizes):
    cap = dict(PROFILES)
    assert (pdf.groupby(["profile", "container_id"])["tokens"].sum() <= pdf.groupby(["profile", "container_id"])["profile"].first().map(cap)).all()
    for (p, d), g in pdf.groupby(["profile", "doc_id"]):
        assert g["tokens"].sum() == sizes[d] and len(g) == max(1, math.ceil(sizes[d] / cap[p]))
        assert sorted(zip(g["piece"], g["token_start"])) == [(i, i * cap[p]) for i in range(len(g))]
    for p, g in pdf.groupby("profile"):
        assert sorted(g["container_id"].unique()) == list(range(g["container_id"].nunique()))


def test_every_item_is_placed_whole_and_room_is_used(spark):
    rng = random.Random(1)
    sizes = [int(rng.lognormvariate(4, 1)) + 1 for _ in range(3000)]
    out, prof = packed(spark, sizes)
    check(out.toPandas(), sizes)
    rep = {r["profile"]: r for r in packing.report(out, prof).collect()}
    assert rep["s"]["unused_share"] < 0.03 and rep["m"]["unused_share"] < 0.03


def test_ties_nulls_empty_and_exact_fit(spark):
    df = spark.createDataFrame([(1, 100), (1, 100), (2, 50), (3, 50), (4, 0), (5, None), (None, 50), (7, 250)], "doc_id long, tokens long")
    prof = spark.createDataFrame([("s", 100)], "profile string, capacity_tokens int")
    pdf = packing.pack(df, prof).toPandas()
    used = pdf.groupby("container_id")["tokens"].sum()
    assert used.max() == 100 and len(used) == 6 and pdf["tokens"].sum() == 600
    assert packing.pack(df.limit(0), prof).count() == 0 and packing.pack(df, prof.limit(0)).count() == 0


def test_one_size_for_a_third_of_all_rows(spark):
    sizes = [40] * 1000 + [30] * 1000 + [7] * 1000
    out, prof = packed(spark, sizes)
    check(out.toPandas(), sizes)
    assert {r["profile"]: r["unused_share"] for r in packing.report(out, prof).collect()}["s"] < 0.03


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 50), max_size=20))
def test_plan_uses_every_item_once_and_never_overfills(sizes):
    hist = [(s, s, n) for s, n in sizes.items()]
    slots, containers = packing.plan(hist, 100)
    used, seen = {}, {s: 0 for s in sizes}
    for cls, lo, hi, m, base in sorted(slots):
        assert lo == seen[cls]
        seen[cls] = hi
        for i in range(lo, hi):
            c = base + (i - lo) // m
            used[c] = used.get(c, 0) + cls
    assert seen == sizes and all(v <= 100 for v in used.values()) and sorted(used) == list(range(containers))


def mixture(spark, docs, targets, **options):
    d = spark.createDataFrame([(i, s, n, 0.0) for i, (s, n) in enumerate(docs)], "doc_id long, source string, tokens long, place double")
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    m = mixing.mix(d, t, **options)
    return m.toPandas(), mixing.shares(m, d, t).toPandas().set_index("source")


def test_targets_are_met_within_repeats(spark):
    rng = random.Random(2)
    docs = [("big", rng.randint(1, 400)) for _ in range(5000)] + [(" Small", rng.randint(1, 400)) for _ in range(60)] + [("other", 50)] * 100 + [(None, 9)]
    pdf, rep = mixture(spark, docs, [("big", 0.9, 1), ("small", 0.1, 5), ("absent", 0.2, 3)])
    assert abs(rep.loc["big", "actual_share"] - 0.9) < 0.002 and rep.loc["absent", "actual_share"] == 0 and set(pdf["source"]) == {"big", "small"}
    assert rep.loc["small", "most_uses"] <= 5 and rep.loc["big", "most_uses"] == 1 and not pdf.duplicated(["source", "doc_id", "use"]).any()
    assert pdf["position"].between(0, 1).all()
    # whole blocks come before the cut one
    uses = pdf[pdf["source"] == "small"].groupby("doc_id")["use"].count()
    assert uses.max() - uses.min() <= 1


def test_larger_size_tilts_towards_own_shares(spark):
    docs = [("a", 10)] * 900 + [("b", 10)] * 100
    pdf, rep = mixture(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], size=8000)
    assert rep["tokens"].sum() >= 7900 and rep.loc["b", "most_uses"] <= 2 and rep.loc["a", "actual_share"] > 0.6


def test_empty_and_unusable_targets(spark):
    pdf, rep = mixture(spark, [("a", 0)], [("a", 1.0, None)])
    assert len(pdf) == 0 and rep.loc["a", "tokens"] == 0
    pdf, _ = mixture(spark, [("a", 5), ("a", 5)], [("a", 1.0, None), (None, 0.5, 1), ("b", -1.0, 2)])
    assert len(pdf) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**6), st.floats(0.01, 1), st.integers(1, 6)), min_size=1, max_size=8), st.floats(0.1, 3))
def test_solver_respects_limits(xs, scale):
    src = [mixing.Source(str(i), t, r, n, 1) for i, (n, t, r) in enumerate(xs)]
    _, a0, size = mixing.solve(src)
    assert a0 == 0 and all(abs(s.weight - s.target / sum(x.target for x in src)) < 1e-9 for s in src)
    out, a, _ = mixing.solve(src, size * scale)
    assert 0 <= a <= 1 and all(s.budget <= s.tokens * s.repeats * (1 + 1e-9) for s in out)


def test_entropy_exponent():
    own = [0.7, 0.2, 0.1]
    a = mixing.entropy_exponent(own, mixing.entropy([0.5, 0.3, 0.2]))
    w = [p**a for p in own]
    assert abs(mixing.entropy([x / sum(w) for x in w]) - mixing.entropy([0.5, 0.3, 0.2])) < 1e-6


def test_token_counts(spark):
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("größe " * 5000,)], "t string")
    n = [r["n"] for r in df.select(tokens.count_tokens(df["t"]).alias("n")).collect()]
    enc = tokens.encoding()
    assert n == [len(enc.encode_ordinary("hello world")), 0, 0, len(enc.encode_ordinary("größe " * 5000))] and isinstance(pd.Series(n).sum().item(), int)


def test_pure_harmonic_fills_each_class_on_its_own(spark):
    rng = random.Random(2)
    sizes = [rng.randint(1, 260) for _ in range(800)]
    df = spark.createDataFrame([(i, n, 0) for i, n in enumerate(sizes)], "doc_id long, tokens long, number long")
    prof = spark.createDataFrame(PROFILES, "profile string, capacity_tokens int")
    pdf = packing.pack(df, prof, pure=True).toPandas()
    check(pdf, sizes)
    for (p, _), g in pdf.groupby(["profile", "container_id"]):
        k = (dict(PROFILES)[p] // g["tokens"]).unique()
        assert len(k) == 1 and len(g) <= k[0]
    plain, mixed = ({r["profile"]: r["unused_share"] for r in packing.report(packing.pack(df, prof, pure=x), prof).collect()} for x in (True, False))
    assert all(mixed[p] < plain[p] for p in mixed)


def test_temperature_moves_between_entropy_and_repetition():
    S = mixing.Source
    make = lambda repeats: [S("a", 0.5, repeats, 900, 9), S("b", 0.5, repeats, 90, 9), S("c", 0.0001, repeats, 10, 9)]
    free, a, size = mixing.tempered(make(100))
    want = mixing.entropy([0.5 / 1.0001, 0.5 / 1.0001, 0.0001 / 1.0001])
    assert size == 1000 and abs(mixing.entropy([s.weight for s in free]) - want) < 1e-6 and 0 < a < 1
    tight, b, _ = mixing.tempered(make(2))
    assert a < b <= 1 and all(s.budget <= 2 * s.tokens * (1 + 1e-9) for s in tight)
    assert abs(max(s.budget / s.tokens for s in tight) - 2) < 1e-6  # the limit is met, not more
    once, c, _ = mixing.tempered(make(1))
    assert abs(c - 1) < 1e-6 and all(abs(s.budget - s.tokens) < 1e-3 for s in once)


def test_tempered_mixture_as_blocks(spark):
    rng = random.Random(3)
    docs = [("a", rng.randint(1, 30)) for _ in range(900)] + [("b", rng.randint(1, 30)) for _ in range(60)]
    d = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(docs)], "doc_id long, source string, tokens long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    out = mixing.mix(d, t, solver=mixing.tempered).toPandas()
    uses = out.groupby(["source", "doc_id"]).size()
    assert uses["a"].max() == 1 and 2 <= uses["b"].max() <= 3
    got = {r["source"]: r["actual_share"] for r in mixing.shares(mixing.mix(d, t, solver=mixing.tempered), d, t).collect()}
    own = sum(n for s, n in docs if s == "b") / sum(n for _, n in docs)
    assert own < got["b"] < 0.5
