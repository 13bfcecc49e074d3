"""Queries on branches: geometry, ranking, splits, merges, reports."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.config import AS_OF, Config
from thicket.functions import vectors as V
from thicket.functions.keys import key
from thicket.operators import geometry, retrieval
from thicket.plans import sqlkit as Q
from thicket.session import table

DIM = Q.DIM
_R = lambda c: F.round(c, 6)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """memory_nodes with clean branch keys."""
    return table(spark, sf_dir, "memory_nodes").withColumn("branch_id", key("branch_id"))


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "branch_states").withColumn("branch_id", key("branch_id"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).select("branch_id", "ingest_seq", "role", "importance_score", "embedding")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the first usable node, which stands for an embedded query."""
    v = table(spark, sf_dir, "memory_nodes").where(V.usable(F.col("embedding"), DIM)).select("ingest_seq", "embedding")
    return [float(x) for x in v.orderBy("ingest_seq").limit(1).collect()[0]["embedding"]]


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches with their stated scalars and the centroid of their nodes."""
    geo = geometry.branch_geometry(_vectors(spark, sf_dir), DIM).select("branch_id", "mean_vec")
    return states(spark, sf_dir).join(geo, "branch_id")


def branch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15-19, VEC1-3, VEC5: geometry of every branch, and the regime it implies."""
    g = geometry.branch_geometry(_vectors(spark, sf_dir), DIM)
    out = g.select("branch_id", "n", *[_R(c).alias(c) for c in ("eff_rank", "trace", "anisotropy", "coherence", "compression_loss")])
    return out.withColumn("regime", geometry.regime(F.col("coherence"), F.col("compression_loss"), F.col("eff_rank"), F.col("anisotropy")))


def branch_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15-16 in long form: mean and variance of every dimension of every branch."""
    g = geometry.branch_geometry(_vectors(spark, sf_dir), DIM)
    both = F.zip_with("mean_vec", "cov_diagonal", lambda m, c: F.struct(m.alias("m"), c.alias("c")))
    return g.select("branch_id", F.posexplode(both).alias("dim", "v")).select("branch_id", (F.col("dim") + 1).cast("long").alias("dim"), _R("v.m").alias("mean"), _R("v.c").alias("variance"))


def role_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20."""
    out = geometry.role_diversity(nodes(spark, sf_dir))
    return out.select("branch_id", "rows", _R("role_diversity").alias("role_diversity"))


def smoothed_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13: a maintenance step on branches with at least eight vectors: stated scalars moved towards the recomputed ones, which begin where there are none."""
    g = geometry.branch_geometry(_vectors(spark, sf_dir), DIM).where("n >= 8")
    names = ("eff_rank", "trace", "anisotropy", "coherence", "compression_loss")
    new = g.select("branch_id", "n", *[F.col(c).alias(f"new_{c}") for c in names])
    rho = Config().ema_rho
    out = states(spark, sf_dir).join(new, "branch_id")
    return out.select("branch_id", "n", *[_R(geometry.smoothed(F.col(c), F.col(f"new_{c}"), rho)).alias(c) for c in names])


def _ranked(mode: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        ranked = retrieval.ranking(_located(spark, sf_dir), query_vector(spark, sf_dir), mode)
        return ranked.select("branch_id", *[_R(c).alias(c) for c in ("sem", "trust", "react", "total")])

    f.__name__ = f"branch_rank_{mode}"
    f.__doc__ = f"TOP1, SCO7-8: the best branches for a query vector, mode {mode}."
    return f


def prefilter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP2: the best by the cheap score, ranked by the exact one, with the limits of Config."""
    cfg = Config()
    ranked = retrieval.cascade(_located(spark, sf_dir), query_vector(spark, sf_dir), limit=cfg.prefilter_limit, top=cfg.result_limit)
    return ranked.select("branch_id", _R("cheap").alias("cheap"), _R("total").alias("total"))


def prefilter_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP2, FLT7: the cascade among branches of the given states that were updated in a span of time, with recency in the
    cheap score as in the exact one."""
    ranked = retrieval.cascade(
        _located(spark, sf_dir), query_vector(spark, sf_dir), limit=64, top=32, states=("ACTIVE", "STABLE", "DORMANT"),
        after=AS_OF - 120 * 86400, before=AS_OF - 86400, boost=0.3, now=AS_OF,
    )
    return ranked.select("branch_id", _R("cheap").alias("cheap"), _R("final").alias("final"))


#: Weights by branch type as a user might set them.
PROFILES = {
    "conversation": {"retrieval_kappa": {"coherence": 0.34, "ret_error": -0.2}, "split_zeta": {"anisotropy": 0.3}, "merge_eta": {"topic": 0.24, "co_use": 0.18}},
    "daily_log": {"retrieval_kappa": {"comp_loss": -0.1}, "split_zeta": {"incoherence": 0.05, "topic_drift": 0.05}},
    "default": {"split_zeta": {"ret_error": 0.1}, "merge_eta": {"cos": 0.2}},
}


def branch_rank_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO20, SCO8: the best branches with weights by branch type."""
    ranked = retrieval.ranking(_located(spark, sf_dir), query_vector(spark, sf_dir), cfg=replace(Config(), profiles=PROFILES))
    return ranked.select("branch_id", *[_R(c).alias(c) for c in ("sem", "trust", "react", "total")])


def rank_with_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP4: relevance blended with recency, over all branches that may be retrieved."""
    keep = _located(spark, sf_dir).where(~F.col("state").isin(list(Config().excluded_states)))
    s = retrieval.score(keep, query_vector(spark, sf_dir))
    out = retrieval.blend(s, "total", "last_update_ts", 0.3, AS_OF)
    return out.select("branch_id", *[_R(c).alias(c) for c in ("relevance", "recency", "final")])


def allocation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP3: the newest 128 eligible branches, the ten best for a new item near the query vector."""
    b = _located(spark, sf_dir).where(~F.col("state").isin(list(Config().excluded_states)))
    new = b.orderBy(F.col("last_update_ts").desc_nulls_last(), "branch_id").limit(128)
    q = F.array(*[F.lit(x) for x in query_vector(spark, sf_dir)])
    age = F.greatest(F.lit(AS_OF) - F.coalesce("last_update_ts", F.lit(0.0)), F.lit(0.0)) / 86400
    s = 0.45 * F.col("usefulness") + 0.25 * F.col("coherence") + 0.10 * F.log1p(F.col("node_count").cast("double")) + 0.20 / (1 + age) + 0.55 * V.cosine(q, F.col("mean_vec"))
    return new.withColumn("score", s).orderBy(F.col("score").desc(), "branch_id").limit(10).select("branch_id", _R("score").alias("score"))


def collapsing_sidecar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP5: collapsing branches ranked on their own."""
    b = _located(spark, sf_dir).where("state = 'COLLAPSING' AND node_count > 0")
    s = retrieval.score(b, query_vector(spark, sf_dir))
    return s.orderBy(F.col("total").desc(), "branch_id").limit(5).select("branch_id", _R("sem").alias("sem"), _R("total").alias("total"))


def _split_score(cfg: Config):
    c, w = F.col, lambda name, x: retrieval.weight(cfg, "split_zeta", name, x)
    return (
        w("incoherence", cfg.zeta_incoherence) * (1 - c("coherence")) + w("anisotropy", cfg.zeta_anisotropy) * c("anisotropy")
        + w("comp_loss", cfg.zeta_compression) * c("compression_loss") + w("ret_error", cfg.zeta_error) * c("retrieval_error")
        + F.abs(w("topic_drift", cfg.zeta_drift)) * c("topic_drift_density")
    )


def split_score_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO5, TOP8: branches by split score with their rank and whether a cap of five takes them."""
    c, cfg = F.col, Config()
    b = states(spark, sf_dir).where("node_count >= 8").withColumn("split_score", _R(_split_score(cfg)))
    # the rank of the few that count; the others are only compared with the fifth
    best = b.orderBy(c("split_score").desc(), "branch_id").limit(5).select("branch_id", F.lit(True).alias("taken"))
    return b.join(F.broadcast(best), "branch_id", "left").select("branch_id", "split_score", F.coalesce("taken", F.lit(False)).alias("taken"))


def split_score_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO20, SCO5: split scores with weights by branch type."""
    b = states(spark, sf_dir).where("node_count >= 8")
    return b.select("branch_id", "branch_type", _R(_split_score(replace(Config(), profiles=PROFILES))).alias("split_score"))


#: Edges that speak for a common topic.
TOPIC_EDGES = ("same_topic", "same_task", "same_user_fact", "derived_from", "summarizes", "refines", "semantic_neighbor")


def branch_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(branch_id, a): every name an edge may give a branch: its own, its nodes' and their records', the latter
    with the prefixes ``msg_`` and ``sn_`` as well."""
    lcm = key("lcm_id")
    prefixed = lambda p: F.when(~lcm.startswith(p), F.concat(F.lit(p), lcm))
    n = nodes(spark, sf_dir).where("branch_id IS NOT NULL")
    names = n.select("branch_id", F.explode(F.array_compact(F.array(key("id"), lcm, prefixed("msg_"), prefixed("sn_")))).alias("a"))
    return names.unionByName(states(spark, sf_dir).where("branch_id IS NOT NULL").select("branch_id", F.col("branch_id").alias("a"))).distinct()


def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO3-4, SCO15, JOIN14-15, JOIN19, AGG7: merge score of the stable or dormant branches that an edge links or a query retrieved together.

    Other pairs have neither overlap nor co-use, and their score stays below any threshold in use.
    """
    from thicket.operators import feedback
    from thicket.plans import messages

    cfg = Config()
    alias = branch_aliases(spark, sf_dir)
    size = alias.groupBy("branch_id").agg(F.count(F.lit(1)).alias("aliases"))
    edges = table(spark, sf_dir, "memory_edges").select(key("src_id").alias("s"), key("dst_id").alias("d"), "edge_type").distinct()
    of = lambda n, m: alias.select(F.col("branch_id").alias(n), F.col("a").alias(m))
    linked = edges.join(of("sb", "s"), "s").join(of("db", "d"), "d").where("sb <> db")
    per = linked.groupBy(F.least("sb", "db").alias("branch_a"), F.greatest("sb", "db").alias("branch_b")).agg(
        F.sum(F.col("edge_type").isin(*TOPIC_EDGES).cast("long")).alias("topic_edges"), F.sum((F.col("edge_type") == "temporal_next").cast("long")).alias("temporal_edges"),
    )
    co = feedback.co_use(messages._feedback(spark, sf_dir)).select("branch_a", "branch_b", "co_use")
    per = per.join(co, ["branch_a", "branch_b"], "full").fillna(0, ["topic_edges", "temporal_edges", "co_use"])
    b = _located(spark, sf_dir).where("state IN ('STABLE', 'DORMANT')").join(size, "branch_id")
    names = ("cos", "topic", "co_use", "topic_drift", "drift")
    mine = [retrieval.weight(cfg, "merge_eta", n, x) for n, x in zip(names, (cfg.eta_cos, cfg.eta_topic, cfg.eta_couse, cfg.eta_topic_drift, cfg.eta_drift))]
    cols = {"m": F.col("mean_vec"), "t": F.col("topic_drift_density"), "d": F.col("anchor_drift"), "n": F.col("aliases"), "w": F.array(*mine)}
    side = lambda x: b.select(F.col("branch_id").alias(f"branch_{x}"), *[c.alias(f"{k}{x}") for k, c in cols.items()])
    p = per.join(side("a"), "branch_a").join(side("b"), "branch_b")
    overlap = F.least(F.lit(1.0), (F.col("topic_edges") + 0.25 * F.col("temporal_edges")) / F.greatest(F.lit(1), F.least("na", "nb")))
    w = [(F.col("wa")[i] + F.col("wb")[i]) / 2 for i in range(len(names))]
    s = w[0] * V.cosine(F.col("ma"), F.col("mb")) + w[1] * overlap + w[2] * F.col("co_use") - F.abs(w[3]) * (F.col("ta") + F.col("tb")) / 2 + w[4] * F.abs(F.col("da") - F.col("db"))
    return p.select("branch_a", "branch_b", "topic_edges", "temporal_edges", _R(overlap).alias("topic_overlap"), _R("co_use").alias("co_use"), _R(s).alias("merge_score"))


def geometry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8-9: branches per state and regime with means of their scalars."""
    return states(spark, sf_dir).groupBy("state", "regime").agg(
        F.count(F.lit(1)).alias("branches"), F.sum("node_count").alias("nodes"),
        *[_R(F.avg(c)).alias(f"avg_{c}") for c in ("eff_rank", "coherence", "role_diversity", "compression_loss", "usefulness", "retrieval_error")],
    )


#: The scalars of a branch that a snapshot holds, beside its last update.
SCALARS = (
    "branch_id", "branch_type", "state", "regime", "eff_rank", "trace", "anisotropy", "anchor_drift", "coherence", "compression_loss", "node_count", "role_diversity", "topic_drift_density",
    "retrieval_error", "usefulness", "reactivation_score", "split_counter", "merge_counter",
)


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG8: how many branches are in each state and regime, wait for a split or a merge, their means, and links across agents."""
    b = states(spark, sf_dir).select(F.coalesce("state", F.lit("FORMING")).alias("state"), F.coalesce("regime", F.lit("PRODUCTIVE")).alias("regime"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("coherence", "compression_loss", "node_count")])
    per = lambda name: b.groupBy(F.concat(F.lit(f"{name}:"), F.col(name)).alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    n = lambda state: F.sum((F.col("state") == state).cast("double"))
    whole = {"pending_split": n("SPLIT_PENDING"), "pending_merge": n("MERGE_CANDIDATE"), "mean_coherence": _R(F.avg("coherence")), "mean_compression_loss": _R(F.avg("compression_loss")), "total_nodes": F.sum("node_count").cast("double")}
    one = b.agg(*[c.alias(k) for k, c in whole.items()]).select(F.explode(F.create_map(*[x for k in whole for x in (F.lit(k), F.col(k))])).alias("measure", "value"))
    e = table(spark, sf_dir, "memory_edges").where("edge_type = 'cross_agent_shared'").agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit("cross_agent_edges").alias("measure"), "value")
    return per("state").unionByName(per("regime")).unionByName(one).unionByName(e)


def state_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5-6: branches in the states that a list or a group names, per request."""
    b = states(spark, sf_dir)
    out = None
    for request, (state, group) in {"list": (" active, Stable,ACTIVE ", None), "all": ("ALL", None), "working": (None, "working"), "settled": (None, "settled"), "dormant": (None, "dormant")}.items():
        wanted = retrieval.state_list(state, group)
        part = (b.where(F.col("state").isin(wanted)) if wanted else b).select(F.lit(request).alias("request"), "branch_id", "state")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("request", "state").agg(F.count(F.lit(1)).alias("branches"))


def snapshot_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK25, FLT1: all scalars of the 100 branches updated last, without excluded states."""
    b = states(spark, sf_dir).where("state NOT IN ('COLLAPSING', 'SPLIT_PENDING')")
    b = b.select(*SCALARS, F.coalesce("last_update_ts", F.lit(0.0)).alias("last_update_ts"))
    return b.orderBy(F.col("last_update_ts").desc(), "branch_id").limit(100)


def branch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG1-5, AGG10: counts by role, mode and correction of every branch, and its last activity."""
    n = nodes(spark, sf_dir)
    is_ = lambda c, v: F.sum((F.col(c) == v).cast("long")).alias(f"{c}_{v}")
    role = F.coalesce("role", F.lit("unknown"))
    per = n.withColumn("role", role).groupBy("branch_id").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.sum((F.coalesce(F.size("embedding"), F.lit(0)) > 0).cast("long")).alias("embedded"),
        *[F.coalesce(is_("role", r), F.lit(0)).alias(f"role_{r}") for r in ("user", "assistant", "unknown")],
        *[F.coalesce(is_("update_mode", m), F.lit(0)).alias(f"mode_{m}") for m in ("attach", "refine", "contradict", "supersede", "fork")],
        *[F.coalesce(is_("correction_kind", m), F.lit(0)).alias(f"kind_{m}") for m in ("refine", "contradict", "supersede")],
        F.count("correction_prev_id").alias("linked"), F.max("correction_version").alias("last_version"), F.max("timestamp").alias("last_ts"),
    )
    return per.where("branch_id IS NOT NULL")


def next_branch_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: the number after the greatest one in use."""
    num = F.regexp_extract("branch_id", r"^conv_([0-9]+)", 1)
    return states(spark, sf_dir).agg(F.concat(F.lit("conv_"), (F.coalesce(F.max(F.when(num != "", num.cast("long"))), F.lit(0)) + 1).cast("string")).alias("next_id"))


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN15: the 50 branch ids after a cursor."""
    return states(spark, sf_dir).where("branch_id > 'conv_2'").select("branch_id").orderBy("branch_id").limit(50)


def activity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT6-10: branches by activity label within 14 days."""
    ts = F.col("last_update_ts")
    label = F.when(ts.isNull() | (ts <= 0), "unknown").when(ts >= AS_OF - 14 * 86400, "recent").otherwise("stale")
    return states(spark, sf_dir).select("branch_id", "state", label.alias("activity"))


QUERIES = {
    f.__name__: f
    for f in (
        branch_stats, branch_centroids, role_diversity, smoothed_stats, _ranked("balanced"), _ranked("factual"), _ranked("exploratory"), branch_rank_by_type, prefilter_cascade, prefilter_recent, rank_with_recency,
        allocation_candidates, collapsing_sidecar, split_score_rank, split_score_by_type, merge_pairs, geometry_stats, health_report, state_groups, snapshot_export, branch_report, next_branch_id, keyset_page, activity_filter,
    )
}

_B = Q.k("branch_id")
_rank_sql = lambda mode: f"WITH {Q.scored(mode)} SELECT branch_id, round(sem, 6) AS sem, round(trust, 6) AS trust, round(react, 6) AS react, round(total, 6) AS total FROM tot WHERE state NOT IN ('COLLAPSING', 'SPLIT_PENDING') ORDER BY tot.total DESC, branch_id LIMIT 128"
_CHEAP = "0.45 * reactivation_score + 0.35 * coherence + 0.12 * usefulness + 0.05 * (1 - compression_loss) + 0.03 * ln(1 + node_count)"
_AGE = f"CASE WHEN last_update_ts IS NULL THEN 0 ELSE pow(2, -greatest({AS_OF} - last_update_ts, 0) / 86400.0 / 14) END"
_count = lambda c, vs, p: ", ".join(f"count(*) FILTER ({c} = '{v}') AS {p}_{v}" for v in vs)

ORACLE = {
    "branch_stats": f"""WITH {Q.NODES}, r AS (SELECT branch_id, n, round(eff_rank, 6) AS eff_rank, round(trace, 6) AS trace, round(anisotropy, 6) AS anisotropy, round(coherence, 6) AS coherence, round(compression_loss, 6) AS compression_loss FROM geo)
SELECT *, CASE WHEN (coherence < 0.45 OR compression_loss > 0.65) AND eff_rank >= 16.5 THEN 'UNSTABLE' WHEN eff_rank < 16.5 OR anisotropy > 0.70 THEN 'RIGID' ELSE 'PRODUCTIVE' END AS regime FROM r""",
    "branch_centroids": f"WITH {Q.NODES} SELECT branch_id, CAST(i AS BIGINT) AS dim, round(m, 6) AS mean, round(c, 6) AS variance FROM mu JOIN var USING (branch_id, i)",
    "role_diversity": f"SELECT {_B} AS branch_id, count(*) AS rows, round(count(DISTINCT coalesce(role, 'unknown')) / count(*), 6) AS role_diversity FROM memory_nodes GROUP BY 1",
    "smoothed_stats": f"""WITH {Q.NODES} SELECT g.branch_id, n, {', '.join(f'round(CASE WHEN s.{c} <= 0 THEN g.{c} ELSE 0.95 * s.{c} + 0.05 * g.{c} END, 6) AS {c}' for c in ('eff_rank', 'trace', 'anisotropy', 'coherence', 'compression_loss'))}
FROM geo g JOIN (SELECT * REPLACE ({_B} AS branch_id) FROM branch_states) s ON g.branch_id = s.branch_id WHERE n >= 8""",
    **{f"branch_rank_{m}": _rank_sql(m) for m in ("balanced", "factual", "exploratory")},
    "prefilter_cascade": f"""WITH {Q.scored('balanced')}, short AS (SELECT *, {_CHEAP} AS cheap FROM tot WHERE state NOT IN ('COLLAPSING', 'SPLIT_PENDING') ORDER BY cheap DESC, branch_id LIMIT 256)
SELECT branch_id, round(cheap, 6) AS cheap, round(total, 6) AS total FROM short ORDER BY short.total DESC, branch_id LIMIT 128""",
    "prefilter_recent": f"""WITH {Q.scored('balanced')}, ok AS (SELECT *, {_CHEAP} AS c0, {_AGE} AS rec FROM tot WHERE state IN ('ACTIVE', 'STABLE', 'DORMANT') AND last_update_ts BETWEEN {AS_OF - 120 * 86400} AND {AS_OF - 86400}),
short AS (SELECT *, 0.7 * c0 + 0.3 * rec AS cheap FROM ok ORDER BY 0.7 * c0 + 0.3 * rec DESC, branch_id LIMIT 64),
s AS (SELECT *, min(total) OVER () AS lo, max(total) OVER () AS hi FROM short),
f AS (SELECT branch_id, cheap, 0.7 * CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE (total - lo) / (hi - lo) END + 0.3 * rec AS final FROM s)
SELECT branch_id, round(cheap, 6) AS cheap, round(final, 6) AS final FROM f ORDER BY f.final DESC, branch_id LIMIT 32""",
    "branch_rank_by_type": f"""WITH {Q.scored('balanced', f"JOIN (SELECT {_B} AS branch_id, lower(trim(branch_type)) AS ty FROM branch_states) USING (branch_id)", "CASE ty WHEN 'conversation' THEN 0.34 ELSE 0.30 END * coherence + CASE ty WHEN 'daily_log' THEN -0.1 ELSE 0.20 END * compression_loss - 0.25 * topic_drift_density + CASE ty WHEN 'conversation' THEN -0.2 ELSE 0.25 END * retrieval_error")}
SELECT branch_id, round(sem, 6) AS sem, round(trust, 6) AS trust, round(react, 6) AS react, round(total, 6) AS total FROM tot WHERE state NOT IN ('COLLAPSING', 'SPLIT_PENDING') ORDER BY tot.total DESC, branch_id LIMIT 128""",
    "rank_with_recency": f"""WITH {Q.scored('balanced')}, ok AS (SELECT *, min(total) OVER () AS lo, max(total) OVER () AS hi FROM tot WHERE state NOT IN ('COLLAPSING', 'SPLIT_PENDING')),
b AS (SELECT branch_id, CASE WHEN hi - lo <= 1e-12 THEN 1.0 ELSE (total - lo) / (hi - lo) END AS relevance, {_AGE} AS recency FROM ok)
SELECT branch_id, round(relevance, 6) AS relevance, round(recency, 6) AS recency, round(0.7 * relevance + 0.3 * recency, 6) AS final FROM b""",
    "allocation_candidates": f"""WITH {Q.scored('balanced')}, new AS (SELECT * FROM tot WHERE state NOT IN ('COLLAPSING', 'SPLIT_PENDING') ORDER BY last_update_ts DESC NULLS LAST, branch_id LIMIT 128),
s AS (SELECT branch_id, 0.45 * usefulness + 0.25 * coherence + 0.10 * ln(1 + node_count) + 0.20 / (1 + greatest({AS_OF} - coalesce(last_update_ts, 0), 0) / 86400.0) + 0.55 * sem AS score FROM new)
SELECT branch_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, branch_id LIMIT 10""",
    "collapsing_sidecar": f"WITH {Q.scored('balanced')} SELECT branch_id, round(sem, 6) AS sem, round(total, 6) AS total FROM tot WHERE state = 'COLLAPSING' AND node_count > 0 ORDER BY tot.total DESC, branch_id LIMIT 5",
    "split_score_rank": f"""WITH b AS (SELECT {_B} AS branch_id, round(0.15 * (1 - coherence) + 0.20 * anisotropy + 0.20 * compression_loss + 0.20 * retrieval_error + 0.25 * topic_drift_density, 6) AS split_score FROM branch_states WHERE node_count >= 8)
SELECT *, row_number() OVER (ORDER BY split_score DESC, branch_id) <= 5 AS taken FROM b""",
    "split_score_by_type": f"""WITH b AS (SELECT *, lower(trim(branch_type)) AS ty FROM branch_states WHERE node_count >= 8)
SELECT {_B} AS branch_id, branch_type, round(CASE ty WHEN 'daily_log' THEN 0.05 ELSE 0.15 END * (1 - coherence) + CASE ty WHEN 'conversation' THEN 0.3 ELSE 0.20 END * anisotropy + 0.20 * compression_loss
  + CASE WHEN ty IN ('conversation', 'daily_log') THEN 0.20 ELSE 0.1 END * retrieval_error + CASE ty WHEN 'daily_log' THEN 0.05 ELSE 0.25 END * topic_drift_density, 6) AS split_score FROM b""",
    "merge_pairs": f"""WITH {Q.NODES}, lc AS (SELECT {_B} AS b, {Q.k('id')} AS i, {Q.k('lcm_id')} AS l FROM memory_nodes),
alias AS (SELECT b, i AS a FROM lc WHERE i IS NOT NULL UNION SELECT b, l FROM lc WHERE l IS NOT NULL UNION SELECT b, 'msg_' || l FROM lc WHERE NOT starts_with(l, 'msg_') UNION SELECT b, 'sn_' || l FROM lc WHERE NOT starts_with(l, 'sn_')
  UNION SELECT {_B}, {_B} FROM branch_states),
sizes AS (SELECT b, count(*) AS n FROM alias WHERE b IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT {Q.k('src_id')} AS s, {Q.k('dst_id')} AS d, edge_type AS t FROM memory_edges),
linked AS (SELECT least(x.b, y.b) AS a, greatest(x.b, y.b) AS b, count(*) FILTER (t IN ({', '.join(f"'{t}'" for t in TOPIC_EDGES)})) AS topic,
  count(*) FILTER (t = 'temporal_next') AS temporal FROM e JOIN alias x ON e.s = x.a JOIN alias y ON e.d = y.a WHERE x.b <> y.b GROUP BY 1, 2),
co AS (SELECT branch_a AS a, branch_b AS b, co FROM (%CO%)),
per AS (SELECT a, b, coalesce(topic, 0) AS topic, coalesce(temporal, 0) AS temporal, coalesce(co, 0) AS co FROM linked FULL JOIN co USING (a, b)),
st AS (SELECT {_B} AS b, topic_drift_density AS td, anchor_drift AS ad, sizes.n FROM branch_states JOIN sizes ON {_B} = sizes.b WHERE state IN ('STABLE', 'DORMANT')),
c AS (SELECT per.a, per.b, sum(p.m * q.m) / ((sqrt(sum(p.m * p.m)) + 1e-9) * (sqrt(sum(q.m * q.m)) + 1e-9)) AS cos FROM per JOIN mu p ON p.branch_id = per.a JOIN mu q ON q.branch_id = per.b AND p.i = q.i GROUP BY 1, 2),
o AS (SELECT per.*, x.td AS xt, y.td AS yt, x.ad AS xd, y.ad AS yd, least(1.0, (topic + 0.25 * temporal) / greatest(1, least(x.n, y.n))) AS ov, cos FROM per JOIN st x ON per.a = x.b JOIN st y ON per.b = y.b JOIN c ON c.a = per.a AND c.b = per.b)
SELECT a AS branch_a, b AS branch_b, topic AS topic_edges, temporal AS temporal_edges, round(ov, 6) AS topic_overlap, round(co, 6) AS co_use, round(0.15 * cos + 0.20 * ov + 0.15 * co - 0.20 * (xt + yt) / 2 + 0.15 * abs(xd - yd), 6) AS merge_score FROM o""",
    "geometry_stats": f"""SELECT state, regime, count(*) AS branches, CAST(sum(node_count) AS BIGINT) AS nodes, {', '.join(f'round(avg({c}), 6) AS avg_{c}' for c in ('eff_rank', 'coherence', 'role_diversity', 'compression_loss', 'usefulness', 'retrieval_error'))} FROM branch_states GROUP BY 1, 2""",
    "health_report": """WITH b AS (SELECT coalesce(state, 'FORMING') AS state, coalesce(regime, 'PRODUCTIVE') AS regime, coalesce(coherence, 0) AS co, coalesce(compression_loss, 0) AS cl, coalesce(node_count, 0) AS n FROM branch_states)
SELECT 'state:' || state AS measure, CAST(count(*) AS DOUBLE) AS value FROM b GROUP BY state UNION ALL SELECT 'regime:' || regime, CAST(count(*) AS DOUBLE) FROM b GROUP BY regime
UNION ALL SELECT 'pending_split', CAST(count(*) FILTER (state = 'SPLIT_PENDING') AS DOUBLE) FROM b UNION ALL SELECT 'pending_merge', CAST(count(*) FILTER (state = 'MERGE_CANDIDATE') AS DOUBLE) FROM b
UNION ALL SELECT 'mean_coherence', round(avg(co), 6) FROM b UNION ALL SELECT 'mean_compression_loss', round(avg(cl), 6) FROM b UNION ALL SELECT 'total_nodes', CAST(sum(n) AS DOUBLE) FROM b
UNION ALL SELECT 'cross_agent_edges', CAST(count(*) AS DOUBLE) FROM memory_edges WHERE edge_type = 'cross_agent_shared'""",
    "state_groups": """WITH g AS (SELECT * FROM (VALUES ('list', 'ACTIVE'), ('list', 'STABLE'), ('working', 'ACTIVE'), ('working', 'FORMING'), ('working', 'REACTIVATING'), ('settled', 'STABLE'), ('dormant', 'STABLE')) AS v(request, state))
SELECT request, state, count(*) AS branches FROM branch_states JOIN g USING (state) GROUP BY 1, 2 UNION ALL SELECT 'all', state, count(*) FROM branch_states GROUP BY 2""",
    "snapshot_export": f"""SELECT {_B} AS branch_id, {', '.join(SCALARS[1:])}, coalesce(last_update_ts, 0) AS last_update_ts FROM branch_states
WHERE state NOT IN ('COLLAPSING', 'SPLIT_PENDING') ORDER BY coalesce(last_update_ts, 0) DESC, 1 LIMIT 100""",
    "branch_report": f"""SELECT {_B} AS branch_id, count(*) AS nodes, count(*) FILTER (len(embedding) > 0) AS embedded, {_count("coalesce(role, 'unknown')", ('user', 'assistant', 'unknown'), 'role')}, {_count('update_mode', ('attach', 'refine', 'contradict', 'supersede', 'fork'), 'mode')},
{_count('correction_kind', ('refine', 'contradict', 'supersede'), 'kind')}, count(correction_prev_id) AS linked, max(correction_version) AS last_version, max("timestamp") AS last_ts FROM memory_nodes WHERE {_B} IS NOT NULL GROUP BY 1""",
    "next_branch_id": f"SELECT 'conv_' || CAST(coalesce(max(CAST(nullif(regexp_extract({_B}, '^conv_([0-9]+)', 1), '') AS BIGINT)), 0) + 1 AS VARCHAR) AS next_id FROM branch_states",
    "keyset_page": f"SELECT {_B} AS branch_id FROM branch_states WHERE {_B} > 'conv_2' ORDER BY 1 LIMIT 50",
    "activity_filter": f"SELECT {_B} AS branch_id, state, CASE WHEN last_update_ts IS NULL OR last_update_ts <= 0 THEN 'unknown' WHEN last_update_ts >= {AS_OF} - 1209600 THEN 'recent' ELSE 'stale' END AS activity FROM branch_states",
}
ORACLE["merge_pairs"] = ORACLE["merge_pairs"].replace("%CO%", Q.CO_USE)
