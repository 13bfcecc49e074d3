"""Ranking of branches for a query vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.functions import vectors as V


def mode_factor(mode: str, cfg: Config = Config()) -> Column:
    """Factor of regime times factor of state, within 0.25 ... 1.5; an unknown mode is balanced."""
    mode = mode if mode in cfg.mode_regime else "balanced"
    table = lambda d, c: F.coalesce(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col(c)], F.lit(1.0))
    return V.clamp(table(cfg.mode_regime[mode], "regime") * table(cfg.mode_state[mode], "state"), 0.25, 1.5)


def weight(cfg: Config, group: str, name: str, fallback: float, branch_type: str = "branch_type") -> Column:
    """The weight that the profile of a row's branch type gives, as a lookup in a constant map.

    The profile of the type is taken, else that of ``default``, else the fallback; a profile that does not name the
    weight means the fallback. Types are compared ignoring case and surrounding blanks; null is no type.
    """
    own = {str(t).strip().lower(): float(p.get(group, {}).get(name, fallback)) for t, p in cfg.profiles.items()}
    default = own.pop("default", fallback)
    if not own:
        return F.lit(default)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in own.items() for x in kv])[F.lower(F.trim(branch_type))], F.lit(default))


def trust(cfg: Config = Config()) -> Column:
    w = lambda name, x: weight(cfg, "retrieval_kappa", name, x)
    c = F.col
    return w("coherence", cfg.kappa_coh) * c("coherence") + w("comp_loss", cfg.kappa_comp) * c("compression_loss") - F.abs(w("topic_drift", cfg.kappa_drift)) * c("topic_drift_density") + w("ret_error", cfg.kappa_error) * c("retrieval_error")


def score(branches: DataFrame, query: list[float], mode: str = "balanced", history: Column | None = None, project: Column | None = None, cfg: Config = Config()) -> DataFrame:
    """``branches`` with sem, trust, react and total for a query vector (a constant of the plan)."""
    q = F.array(*[F.lit(float(x)) for x in query])
    out = branches.withColumn("sem", V.cosine(q, F.col("mean_vec"))).withColumn("trust", trust(cfg))
    hist, proj = history if history is not None else F.lit(0.0), project if project is not None else F.lit(0.0)
    out = out.withColumn("react", 0.5 * F.col("sem") + weight(cfg, "retrieval_kappa", "hist", cfg.kappa_hist) * hist + cfg.kappa_project * proj)
    return out.withColumn("total", (cfg.alpha_sem * F.col("sem") + cfg.beta_trust * F.col("trust") + cfg.delta_react * F.col("react")) * mode_factor(mode, cfg))


def recency(ts: Column, now: float, half_life_days: float) -> Column:
    """2 ^ (-age / half life); 0 for an unknown time."""
    age = F.greatest(F.lit(now) - ts, F.lit(0.0)) / 86400.0
    return F.when(ts.isNull(), F.lit(0.0)).otherwise(F.pow(F.lit(2.0), -age / max(half_life_days, 0.01)))


def blend(rows: DataFrame, score_col: str, ts_col: str, boost: float, now: float, half_life_days: float = 14.0) -> DataFrame:
    """``rows`` with relevance (min-max scaled), recency and final. The extremes are one small row."""
    ends = F.broadcast(rows.agg(F.min(score_col).alias("_lo"), F.max(score_col).alias("_hi")))
    out = rows.join(ends)
    span = F.col("_hi") - F.col("_lo")
    out = out.withColumn("relevance", F.when(span <= 1e-12, 1.0).otherwise((F.col(score_col) - F.col("_lo")) / span))
    out = out.withColumn("recency", recency(F.col(ts_col), now, half_life_days))
    return out.withColumn("final", (1 - boost) * F.col("relevance") + boost * F.col("recency")).drop("_lo", "_hi")


def cheap_score() -> Column:
    """What a branch is worth without its vector."""
    c = F.col
    history, health = c("reactivation_score"), c("coherence")
    return 0.45 * history + 0.35 * health + 0.12 * c("usefulness") + 0.05 * (1 - c("compression_loss")) + 0.03 * F.log1p(c("node_count").cast("double"))


#: The states of each group (fixed values).
STATE_GROUPS = {"working": ("FORMING", "ACTIVE", "REACTIVATING"), "settled": ("STABLE",), "dormant": ("STABLE",)}


def state_list(state: str | list[str] | None = None, group: str | None = None) -> list[str] | None:
    """The states that a text or list names, each once and in capitals, else those of the group; null for all (ALL, *)."""
    named = [s.strip().upper() for s in (state.split(",") if isinstance(state, str) else state or []) if s and s.strip()]
    if any(s in ("ALL", "*") for s in named):
        named = []
    return list(dict.fromkeys(named)) or list(STATE_GROUPS.get(str(group or "").strip().lower(), ())) or None


def eligible(
    branches: DataFrame, cfg: Config = Config(), states: tuple[str, ...] | None = None, after: float | None = None, before: float | None = None,
    ids: DataFrame | None = None, ts_col: str = "last_update_ts",
) -> DataFrame:
    """Branches that may be retrieved: with a mean vector and in no excluded state (a null state is none), or in one of
    ``states`` if given; within the bounds of time, where a null time lies in none; and in ``ids`` (branch_id)."""
    known = F.coalesce(F.col("state").isin(list(states or cfg.excluded_states)), F.lit(False))
    out = branches.where((known if states else ~known) & F.col("mean_vec").isNotNull())
    if after is not None:
        out = out.where(F.col(ts_col) >= after)
    if before is not None:
        out = out.where(F.col(ts_col) <= before)
    return out if ids is None else out.join(ids.select("branch_id"), "branch_id", "left_semi")


def ranking(branches: DataFrame, query: list[float], mode: str = "balanced", top: int | None = None, cfg: Config = Config()) -> DataFrame:
    """The best of all eligible branches by the exact score: scored in parallel, each task sends its best ``top`` only."""
    return score(eligible(branches, cfg), query, mode, cfg=cfg).orderBy(F.col("total").desc(), "branch_id").limit(top or cfg.result_limit)


def cascade(
    branches: DataFrame, query: list[float], mode: str = "balanced", limit: int | None = None, top: int | None = None, cfg: Config = Config(),
    boost: float = 0.0, now: float | None = None, half_life_days: float = 14.0, ts_col: str = "last_update_ts", **filters,
) -> DataFrame:
    """Filter, the best by the cheap score, then the exact score of those; ties by branch id.

    With ``boost`` recency (at the time ``now``) is blended into both scores, and the result is ranked by ``final``.
    """
    cheap = cheap_score()
    if boost:
        cheap = (1 - boost) * cheap + boost * recency(F.col(ts_col), now, half_life_days)
    short = eligible(branches, cfg, ts_col=ts_col, **filters).withColumn("cheap", cheap).orderBy(F.col("cheap").desc(), "branch_id").limit(max(8, limit or cfg.prefilter_limit))
    ranked = score(short, query, mode, cfg=cfg)
    if boost:
        ranked = blend(ranked, "total", ts_col, boost, now, half_life_days)
    return ranked.orderBy(F.col("final" if boost else "total").desc(), "branch_id").limit(top or cfg.result_limit)


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of every group; the limit is applied in each task before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
