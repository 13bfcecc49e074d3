"""Sources mixed to target weights.

Temperature mixing: the weights are the normalised geometric path between the target shares and the
sources' own token shares, ``target^(1-a) * own^a``; the exponent is bisected to the least one at which
no source has to repeat more often than allowed for the wanted size (``a = 0`` is the targets
themselves; without a wanted size the largest one is taken for which the targets can be met exactly).
``tempered`` is the plain form: the normalised powers ``own^a``, with the exponent bisected to the entropy of the targets,
and from there on towards ``own`` itself as far as the limits of repetition ask for at the wanted size.

The weights are realised as block permutations within a token budget: a source is used as whole
blocks (each document once, in an order of its own keyed by the block), and the last block is cut where the budget
ends. The place of the cut is found from sums of buckets of the order; only the bucket that the cut
falls in is gone through document by document, leaving out those that no longer fit.

Names of sources are compared ignoring case and surrounding blanks. Sources without target, or with
none or only empty documents, contribute nothing; the targets of the others are scaled to 1. A null or
negative limit of repeats counts as 1. Documents with the same id count each. Empty tables give no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.keys import key
from thicket.session import Scratch

#: Documents that a bucket of the order should hold.
BUCKET_DOCS = 2000
#: Buckets of a source at most; beyond, buckets hold more documents.
MOST_BUCKETS = 100_000


@dataclass
class Source:
    source: str
    target: float
    repeats: int
    tokens: int
    docs: int
    weight: float = 0.0
    budget: float = 0.0


def _normal(xs: list[float]) -> list[float]:
    total = sum(xs)
    return [x / total for x in xs]


def entropy(shares: list[float]) -> float:
    return -sum(p * math.log(p) for p in shares if p > 0)


def entropy_exponent(own: list[float], wanted: float, steps: int = 60) -> float:
    """The exponent in 0 ... 8 at which the entropy of ``own^a`` is ``wanted`` (it falls as the exponent grows)."""
    lo, hi = 0.0, 8.0
    for _ in range(steps):
        mid = (lo + hi) / 2
        if entropy(_normal([p**mid for p in own])) > wanted:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def solve(sources: list[Source], size: float | None = None, steps: int = 60) -> tuple[list[Source], float, float]:
    """Sources with weight and budget, the exponent and the size in tokens."""
    if not sources:
        return [], 0.0, 0.0
    target = _normal([s.target for s in sources])
    own = _normal([float(s.tokens) for s in sources])
    limit = [float(s.tokens) * s.repeats for s in sources]
    largest = min(c / t for c, t in zip(limit, target))
    size = largest if size is None else min(float(size), sum(limit))
    weights = lambda a: _normal([t ** (1 - a) * p**a for t, p in zip(target, own)])
    fits = lambda a: all(w * size <= c * (1 + 1e-12) for w, c in zip(weights(a), limit))
    lo, hi = 0.0, 1.0
    if fits(0.0):
        hi = 0.0
    else:
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
    for s, w, c in zip(sources, weights(hi), limit):
        s.weight, s.budget = w, min(w * size, c)
    return sources, hi, size


def tempered(sources: list[Source], size: float | None = None, steps: int = 60) -> tuple[list[Source], float, float]:
    """Sources with weight and budget by plain temperature, the exponent and the size in tokens (all tokens once if not given)."""
    if not sources:
        return [], 0.0, 0.0
    own = _normal([float(s.tokens) for s in sources])
    limit = [float(s.tokens) * s.repeats for s in sources]
    size = float(sum(s.tokens for s in sources)) if size is None else min(float(size), sum(limit))
    weights = lambda a: _normal([p**a for p in own])
    fits = lambda a: all(w * size <= c * (1 + 1e-12) for w, c in zip(weights(a), limit))
    a = entropy_exponent(own, entropy(_normal([s.target for s in sources])))
    if not fits(a) and fits(1.0):
        lo, hi = a, 1.0  # either side of the two may be the larger
        for _ in range(steps):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if fits(mid) else (mid, hi)
        a = hi
    for s, w, c in zip(sources, weights(a), limit):
        s.weight, s.budget = w, min(w * size, c)
    return sources, a, size


def measured(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, list[Source]]:
    """Documents of the listed sources with tokens (doc_id, source, tokens), and the sources (a short list)."""
    t = targets.select(key("source").alias("source"), "target_share", F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1)).alias("repeats"))
    t = t.where("source IS NOT NULL AND target_share > 0").groupBy("source").agg(F.sum("target_share").alias("target"), F.max("repeats").alias("repeats"))
    listed = docs.select("doc_id", key("source").alias("source"), "tokens").where("tokens > 0")
    listed = Scratch(docs.sparkSession, "mixing").save(listed.join(F.broadcast(t.select("source")), "source", "left_semi"), "docs")
    per = listed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = per.join(t, "source").orderBy("source").collect()
    return listed, [Source(r["source"], float(r["target"]), int(r["repeats"]), int(r["tokens"]), int(r["docs"])) for r in rows]


def _cut(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of one bucket, in order, as far as they fit into what is left of the budget."""
    pdf = pdf.sort_values(["place", "doc_id"])
    room, keep = float(pdf["room"].iloc[0]), []
    for n in pdf["tokens"]:
        fits = n <= room
        keep.append(fits)
        room -= n if fits else 0
    return pdf[keep][["source", "doc_id", "tokens", "block", "place", "blocks"]]


def mix(docs: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 42, solver=solve) -> DataFrame:
    """(source, doc_id, use, tokens, position): one row for every use of a document.

    ``position`` in 0 ... 1 orders the mixture so that every stretch of it has the wanted shares.
    """
    spark = docs.sparkSession
    listed, sources = measured(docs, targets)
    sources, _, _ = solver(sources, size)
    rows = []
    for s in sources:
        blocks = s.budget / s.tokens
        whole = min(int(blocks + 1e-9), s.repeats)
        rows.append((s.source, whole, max(0.0, s.budget - whole * s.tokens), max(blocks, 1e-12), max(1, min(s.docs // BUCKET_DOCS, MOST_BUCKETS))))
    scheme = "source string, whole int, rest double, blocks double, buckets int"
    plan = F.broadcast(spark.createDataFrame(rows, scheme))
    # each document of each block has a place in that block's order; the last block is the cut one
    placed = listed.join(plan, "source").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("whole"))))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "block", "doc_id"), 11) / F.lit(float(1 << 53))
    placed = placed.withColumn("place", unit)
    whole = placed.where("block < whole").select("source", "doc_id", "tokens", "block", "place", "blocks")
    last = placed.where("block = whole AND rest > 0").withColumn("bucket", F.floor(F.col("place") * F.col("buckets")).cast("int"))
    sums = last.groupBy("source", "bucket", "rest").agg(F.sum("tokens").alias("t"))
    # as many rows as buckets: the sums of one source are few
    before = F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("room", F.col("rest") - before).where("room > 0").select("source", "bucket", "room", "t")
    inside = last.join(sums, ["source", "bucket"])
    full = inside.where("t <= room").select("source", "doc_id", "tokens", "block", "place", "blocks")
    schema = "source string, doc_id long, tokens long, block int, place double, blocks double"
    cut = inside.where("t > room").select("source", "doc_id", "tokens", "block", "place", "blocks", "room").groupBy("source").applyInPandas(_cut, schema)
    used = whole.unionByName(full).unionByName(cut)
    return used.select("source", "doc_id", F.col("block").alias("use"), "tokens", ((F.col("block") + F.col("place")) / F.greatest("blocks", F.col("block") + F.col("place"))).alias("position"))


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: tokens and share reached, target, most uses of one document, own tokens."""
    total = mixed.agg(F.sum("tokens").alias("all"))
    per_doc = mixed.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.max("use").alias("last"), F.count(F.lit(1)).alias("uses"))
    per = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("uses").alias("most_uses"), F.count(F.lit(1)).alias("docs"))
    own = docs.groupBy(key("source").alias("source")).agg(F.sum("tokens").alias("own_tokens"))
    t = targets.select(key("source").alias("source"), "target_share", "max_repeats")
    out = t.join(per, "source", "left").join(own, "source", "left").join(F.broadcast(total))
    return out.select(
        "source", "target_share", "max_repeats", F.coalesce("own_tokens", F.lit(0)).alias("own_tokens"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"),
    )
