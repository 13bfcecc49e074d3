"""Topic drift: pairs of nodes of a branch far apart in order and opposite in direction."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.config import EPS, Config
from thicket.functions import vectors as V
from thicket.operators.lineage import ordered
from thicket.operators.retrieval import top_per_group


def evenly(rank: Column, total: Column, target: int) -> Column:
    """True for ``target`` evenly spaced places of 0 ... total-1, both ends included; all if there are no more.

    Place r is taken if some j has floor(j (total-1) / (target-1)) = r, that is if the least such j,
    ceil(r (target-1) / (total-1)), leads back to r. The step is above 1 wherever places are left out, so no two j meet and none
    has to be filled up.
    """
    if target < 2:
        return rank < target
    step = (total - 1) / F.lit(float(target - 1))
    j = F.ceil(rank / step - F.lit(1e-9))
    return (total <= target) | (F.floor(j * step + F.lit(1e-9)) == rank)


def sample(nodes: DataFrame, size: int) -> DataFrame:
    """At most ``size`` nodes of every branch, evenly spaced in order, with their place from 0.

    Places come from slices of time (``ordered``), so a branch of any length is sampled in parallel.
    """
    o = ordered(nodes)
    n = nodes.where("branch_id IS NOT NULL").groupBy("branch_id").agg(F.count(F.lit(1)).alias("total"))
    picked = o.join(n, "branch_id").where(evenly(F.col("rank") - 1, F.col("total"), size))
    # the place within the sample follows from the rank alone
    step = (F.col("total") - 1) / F.lit(float(size - 1))
    place = F.when(F.col("total") <= size, F.col("rank") - 1).otherwise(F.ceil((F.col("rank") - 1) / step - F.lit(1e-9)))
    return picked.withColumn("place", place.cast("long")).drop("prev_id", "total")


def pairs(sampled: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(branch_id, newer, older, sim) of eligible pairs: both roles, tokens and lengths allow it, and the places are far
    enough apart. A branch has at most ``drift_sample`` nodes here, so its pairs are bounded."""
    ok = sampled.where(
        F.col("role").isin(list(cfg.drift_roles)) & (F.col("token_count") >= cfg.drift_min_tokens) & (F.col("chars") >= cfg.drift_min_chars) & F.col("embedding").isNotNull()
    )
    side = lambda x: ok.select("branch_id", F.col("place").alias(f"p{x}"), F.col("id").alias(f"id{x}"), V.doubles("embedding").alias(f"v{x}"))
    both = side("a").join(side("b"), "branch_id").where(F.col("pb") - F.col("pa") >= cfg.drift_gap)
    return both.select("branch_id", F.col("idb").alias("newer"), F.col("ida").alias("older"), V.cosine(F.col("va"), F.col("vb")).alias("sim"))


def found(sampled: DataFrame, cfg: Config = Config()) -> DataFrame:
    """(branch_id, eligible, drifting, edges): the same pairs counted, and the most opposite ones, from one product of the at most
    ``drift_sample`` vectors of each branch with themselves; only these travel, never a pair."""
    ok = sampled.where(
        F.col("role").isin(list(cfg.drift_roles)) & (F.col("token_count") >= cfg.drift_min_tokens) & (F.col("chars") >= cfg.drift_min_chars) & F.col("embedding").isNotNull()
    ).select("branch_id", "id", "place", "embedding")

    def f(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        n = np.sqrt((x * x).sum(axis=1)) + EPS
        sims, place, ids = (x @ x.T) / np.outer(n, n), pdf["place"].to_numpy(), pdf["id"].to_numpy()
        far = place[:, None] - place[None, :] >= cfg.drift_gap  # row newer, column older
        new, old = np.nonzero(far & (sims < cfg.drift_sim))
        best = sorted(zip(sims[new, old].tolist(), ids[new], ids[old]))[: cfg.drift_edges]
        edges_ = [{"newer": a, "older": b, "sim": s} for s, a, b in best]
        return pd.DataFrame({"branch_id": [pdf["branch_id"].iloc[0]], "eligible": [int(far.sum())], "drifting": [len(new)], "edges": [edges_]})

    out = ok.groupBy("branch_id").applyInPandas(f, "branch_id string, eligible long, drifting long, edges array<struct<newer:string,older:string,sim:double>>")
    return out.where("eligible > 0")


def density(pairs_: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Per branch: eligible pairs, drifting ones, and their share."""
    drifting = F.sum((F.col("sim") < cfg.drift_sim).cast("long"))
    per = pairs_.groupBy("branch_id").agg(F.count(F.lit(1)).alias("eligible"), drifting.alias("drifting"))
    return per.withColumn("density", F.col("drifting") / F.greatest(F.col("eligible"), F.lit(1)))


def edges(pairs_: DataFrame, cfg: Config = Config()) -> DataFrame:
    """The most opposite pairs of every branch as edges from the newer node to the older."""
    far = pairs_.where(F.col("sim") < cfg.drift_sim)
    top = top_per_group(far, ["branch_id"], [F.col("sim"), F.col("newer"), F.col("older")], cfg.drift_edges)
    return top.select("branch_id", "newer", "older", V.clamp(0.5 * (1 - F.col("sim"))).alias("weight"))
