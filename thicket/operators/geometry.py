"""Geometry of branches from the vectors of their nodes.

Everything a branch needs (weighted mean, diagonal variance, effective rank, trace, anisotropy, mean
cosine to the centroid) is linear in three families of sums, so one partial aggregate per
branch crosses the network instead of its vectors: the cosine of a node to the centroid is the product
of its unit vector with the centroid's, and unit vectors add up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.config import EPS, Config
from thicket.functions import vectors as V

#: A variance below this is rounding and counts as none.
LEAST_VARIANCE = 1e-10


def branch_sums(nodes: DataFrame, dim: int, by: str = "branch_id", vec: str = "embedding", weight: Column | None = None) -> DataFrame:
    """(by, n, w, wx, wxx, wu): counts and weighted sums of x, x squared and x / (norm + eps)."""
    w = F.greatest(F.coalesce(F.col("importance_score"), F.lit(0.5)), F.lit(1e-6)) if weight is None else weight
    rows = nodes.where(V.usable(F.col(vec), dim)).select(by, V.doubles(vec).alias("x"), w.alias("_w"))
    rows = rows.withColumn("_n", V.norm(F.col("x")) + F.lit(EPS))
    at = lambda i: F.col("x")[i]
    arr = lambda f: F.array(*[F.sum(f(i)) for i in range(dim)])
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_w").alias("w"),
        arr(lambda i: F.col("_w") * at(i)).alias("wx"), arr(lambda i: F.col("_w") * at(i) * at(i)).alias("wxx"), arr(lambda i: F.col("_w") * at(i) / F.col("_n")).alias("wu"),
    )


def branch_geometry(nodes: DataFrame, dim: int, by: str = "branch_id", cfg: Config = Config(), **options) -> DataFrame:
    """(by, n, mean_vec, cov_diagonal, eff_rank, trace, anisotropy, coherence, compression_loss)."""
    s = branch_sums(nodes, dim, by, **options)
    w = F.col("w") + F.lit(EPS)
    out = s.withColumn("mean_vec", F.transform("wx", lambda x: x / w))
    # sum of w (x - m)^2 = wxx - 2 m wx + m^2 sum(w)
    spread = lambda p, m: p["a"] - 2 * m * p["b"] + m * m * F.col("w")
    both = F.zip_with("wxx", "wx", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    cov = F.zip_with(both, "mean_vec", lambda p, m: F.when(spread(p, m) / w > LEAST_VARIANCE, spread(p, m) / w).otherwise(0.0))
    out = out.withColumn("cov_diagonal", cov)
    coh = V.dot(F.col("wu"), F.col("mean_vec")) / (V.norm(F.col("mean_vec")) + F.lit(EPS)) / w
    out = out.select(
        by, "n", "mean_vec", "cov_diagonal", V.effective_rank(F.col("cov_diagonal")).alias("eff_rank"), V.total(F.col("cov_diagonal")).alias("trace"),
        V.anisotropy(F.col("cov_diagonal")).alias("anisotropy"), coh.alias("coherence"),
    )
    return out.withColumn("compression_loss", compression_loss(F.col("coherence"), F.col("anisotropy"), cfg))


def compression_loss(coherence: Column, aniso: Column, cfg: Config = Config()) -> Column:
    return V.clamp(cfg.loss_beta1 * V.clamp(1 - coherence) + cfg.loss_beta2 * V.clamp(aniso))


def role_diversity(nodes: DataFrame, by: str = "branch_id") -> DataFrame:
    """Distinct roles over rows; a null role counts as one role named unknown."""
    role = F.coalesce("role", F.lit("unknown"))
    per = nodes.groupBy(by, role.alias("r")).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy(by).agg((F.count("r") / F.sum("c")).alias("role_diversity"), F.sum("c").alias("rows"))


def smoothed(old: Column, new: Column, rho: float) -> Column:
    """An exponential mean with the first positive value as its start."""
    return F.when(old <= 0, new).otherwise((1 - rho) * old + rho * new)


def regime(coh: Column, comp: Column, rank: Column, aniso: Column, cfg: Config = Config()) -> Column:
    rigid = rank < 0.15 * cfg.rank_mid
    return F.when(((coh < 0.45) | (comp > 0.65)) & ~rigid, "UNSTABLE").when(rigid | (aniso > 0.70), "RIGID").otherwise("PRODUCTIVE")


def plain_sums(rows: DataFrame, by: str, vec: str, dim: int) -> DataFrame:
    """(by, n, mean_vec, spread): plain mean, and the mean of the squared deviations over all entries, as one aggregate."""
    at = lambda i: F.col(vec)[i].cast("double")
    s = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(at(i)) for i in range(dim)]).alias("_s"), F.sum(sum((at(i) * at(i) for i in range(dim)), F.lit(0.0))).alias("_q"))
    s = s.withColumn("mean_vec", F.transform("_s", lambda x: x / (F.col("n") + F.lit(EPS))))
    spread = (F.col("_q") - 2 * V.dot(F.col("_s"), F.col("mean_vec")) + F.col("n") * V.dot(F.col("mean_vec"), F.col("mean_vec"))) / (F.col("n") * dim)
    return s.select(by, "n", "mean_vec", spread.alias("spread"))


def summary_health(summary: Column, mean: Column, spread: Column, contradictions: Column | None = None, expansions: Column | None = None, cfg: Config = Config()) -> tuple[Column, Column]:
    """(health, loss) of a summary against the vectors it stands for."""
    far = F.least(F.abs(F.ln(F.greatest(spread, F.lit(EPS))) - F.ln(F.lit(2 * EPS))) / 10, F.lit(1.0))
    cos = V.cosine(summary, mean)
    loss = cfg.summary_beta1 * (1 - cos) + cfg.summary_beta2 * far
    health = cfg.omega_sem * cos + cfg.omega_loss * loss
    health = health + cfg.omega_contradiction * (contradictions if contradictions is not None else F.lit(0.0))
    return health + cfg.omega_expand * (expansions if expansions is not None else F.lit(0.0)), loss


def advice(health: Column) -> Column:
    return F.when(health > 0.70, "healthy").when(health > 0.45, "refine").otherwise("split_or_prevent_condensation")
