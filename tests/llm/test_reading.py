import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import reading

FOLDER = "/root/testdata/sf0.01"


def test_prose_leaves_out_code_marks_and_labels(spark):
    text = "# Title here\nuser: The job is full.\n```\nx = 1\n```\n- a point `cfg.x` = 12.\nassert stats['a_b'] >= 3\n[geo] tool=x\r\nSELECT a FROM b;\n\n> quoted line"
    got = spark.createDataFrame([(text,)], "t string").select(reading.prose(F.col("t")).alias("p")).first()["p"]
    assert [" ".join(x.split()) for x in got] == ["Title here", "The job is full.", "a point", "quoted line"]


def test_language_by_function_words(spark):
    rows = [("the cat is on the mat", None), ("der Hund ist in dem Haus und", "EN"), ("le chat est dans la maison des", "x"), ("el gato es de la casa y no", None), ("xyz", "de-DE"), ("xyz", None)]
    df = spark.createDataFrame(rows, "t string, l string")
    assert [r["g"] for r in df.select(reading.language(reading.words(F.col("t")), F.col("l")).alias("g")).collect()] == ["en", "de", "fr", "es", "de", "en"]


def test_coverage_against_brute_force(spark):
    rng = np.random.default_rng(0)
    vocab = ["the", "of", "and"] + [f"w{c}{d}" for c in "abcdefgh" for d in "xyzuv"]
    p = 1 / np.arange(1, len(vocab) + 1)
    docs = [(i, " ".join(rng.choice(vocab, size=rng.integers(1, 60), p=p / p.sum())) + ".", "en", 7) for i in range(80)] + [(900, None, None, 1), (901, "", "en", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, rank long")
    for head in (5, 10_000):
        got = {r["doc_id"]: r for r in reading.features(df, head=head).collect()}
        count = {}
        for _, t, *_ in docs:
            for w in (t or "").strip(".").split():
                w = "".join(ch for ch in w if ch.isalpha())
                count[w] = count.get(w, 0) + 1
        rank = {w: sum(v >= count[w] for v in count.values()) for w in count}
        for i, t, *_ in docs[:80]:
            ranks = sorted(rank["".join(ch for ch in w if ch.isalpha())] for w in t.strip(".").split())
            for share in reading.COVER:
                need = next(r for j, r in enumerate(ranks) if (np.searchsorted(ranks, r, "right")) / len(ranks) >= share - 1e-12)
                assert got[i][f"cover_{int(share * 100)}"] == need
        assert got[900]["n_words"] == 0 and got[901]["cover_90"] is None and len(got) == 82


def test_no_labels_and_empty(spark):
    df = spark.createDataFrame([(1, "the cat sat on the mat", "en")], "doc_id long, text string, lang string")
    lab = spark.createDataFrame([], "doc_id long, band int")
    r = reading.levels(df, lab).first()
    assert r["level"] is None and r["n_words"] == 6
    assert reading.levels(df.limit(0), lab).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/reading_labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    out = reading.levels(docs, labels.where(~held)).join(labels.where(held).groupBy("doc_id").agg(F.avg("band").alias("y")), "doc_id").toPandas()
    graded = out[out["y"] >= 1]
    assert (out[out["y"] == 0]["band"] == 0).all()
    a, t = graded["level"] >= 3.5, graded["y"] >= 3.5
    assert (a & t).sum() / a.sum() > 0.8 and (a & t).sum() / t.sum() > 0.8
    assert np.sqrt(((graded["level"] - graded["y"]) ** 2).mean()) < 0.55


def test_long_inline_code_and_long_tokens(spark):
    got = reading.prose_of("We ran `" + "x " * 500 + "` and it was fine. " + "a" * 200_000 + " " + "the words of the page go on and on for a while so that it is prose " * 3 + "b_" + "c" * 50_000)
    assert len(got) == 1 and "x x" not in got[0] and "b_" not in got[0] and got[0].startswith("We ran")
    assert reading.prose_of("Cafe\u0301 is open")[0] == "Café is open"


def test_long_prose_with_a_sign_of_code_stays(spark):
    long = "the people of the town were glad to see that the old bridge had been built again after the flood of that year "
    texts = [long + "(see note 8): `x`", long + "and so they said;", "[3] " + long, "return of " + long, long + "with max_size = 3 kept", "a_b = f(x);\nreturn the value;\n[job] state=done rows=5 took ten seconds"]
    got = [r["p"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(reading.prose(F.col("t")).alias("p")).collect()]
    assert all(len(g) == 1 and "old bridge" in g[0] for g in got[:5]) and got[5] == []
    assert "max_size" not in got[4][0] and "kept" in got[4][0]
