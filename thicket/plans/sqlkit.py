"""Fragments of the SQL twins."""


def k(c: str) -> str:
    """A key: trimmed, lower case, blank is null."""
    return rf"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"


DIM = 64
EPS = "1e-9"

#: Usable nodes: branch, weight, vector as doubles, and its parts in long form.
NODES = f"""nodes AS (
  SELECT {k('branch_id')} AS branch_id, ingest_seq, role, greatest(coalesce(importance_score, 0.5), 1e-6) AS w, CAST(embedding AS DOUBLE[]) AS x
  FROM memory_nodes WHERE len(embedding) = {DIM}
    AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
long AS (SELECT branch_id, ingest_seq, w, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM nodes),
size AS (SELECT branch_id, count(*) AS n, sum(w) AS sw FROM nodes GROUP BY 1),
mu AS (SELECT l.branch_id, i, sum(l.w * v) / (any_value(sw) + {EPS}) AS m FROM long l JOIN size s USING (branch_id) GROUP BY 1, 2),
var0 AS (SELECT l.branch_id, i, sum(l.w * (v - m) * (v - m)) / (any_value(sw) + {EPS}) AS c FROM long l JOIN mu USING (branch_id, i) JOIN size USING (branch_id) GROUP BY 1, 2),
var AS (SELECT branch_id, i, CASE WHEN c > 1e-10 THEN c ELSE 0 END AS c FROM var0),
mass AS (SELECT branch_id, sum(c) AS trace, max(c) AS mx FROM var GROUP BY 1),
spec AS (SELECT branch_id, exp(-sum(CASE WHEN c / (trace + {EPS}) > {EPS} THEN c / (trace + {EPS}) * ln(c / (trace + {EPS}) + {EPS}) ELSE 0 END)) AS eff_rank,
  any_value(trace) AS trace, any_value(mx) / (any_value(trace) + {EPS}) AS anisotropy FROM var JOIN mass USING (branch_id) GROUP BY 1),
cosn AS (SELECT l.branch_id, ingest_seq, any_value(l.w) AS w, sum(v * m) / ((sqrt(sum(v * v)) + {EPS}) * (sqrt(sum(m * m)) + {EPS})) AS c FROM long l JOIN mu USING (branch_id, i) GROUP BY 1, 2),
coh AS (SELECT branch_id, sum(w * c) / (sum(w) + {EPS}) AS coherence FROM cosn GROUP BY 1),
geo AS (SELECT branch_id, n, eff_rank, trace, anisotropy, coherence,
  greatest(0, least(1, 0.5 * greatest(0, least(1, 1 - coherence)) + 0.3 * greatest(0, least(1, anisotropy)))) AS compression_loss
  FROM size JOIN spec USING (branch_id) JOIN coh USING (branch_id))"""

#: The first usable node's vector is the query.
QUERY = f"q AS (SELECT i, v AS qv FROM long WHERE ingest_seq = (SELECT min(ingest_seq) FROM nodes))"

_F = {
    "balanced": ("CASE regime WHEN 'PRODUCTIVE' THEN 1.05 WHEN 'RIGID' THEN 0.95 WHEN 'UNSTABLE' THEN 0.85 ELSE 1.0 END",
                 "CASE state WHEN 'REACTIVATING' THEN 1.03 WHEN 'DORMANT' THEN 0.92 WHEN 'TENSIONED' THEN 0.90 WHEN 'FORMING' THEN 0.90 ELSE 1.0 END"),
    "factual": ("CASE regime WHEN 'PRODUCTIVE' THEN 1.10 WHEN 'RIGID' THEN 0.90 WHEN 'UNSTABLE' THEN 0.60 ELSE 1.0 END",
                "CASE state WHEN 'STABLE' THEN 1.05 WHEN 'ACTIVE' THEN 1.0 WHEN 'REACTIVATING' THEN 0.95 WHEN 'DORMANT' THEN 0.85 WHEN 'TENSIONED' THEN 0.75 WHEN 'FORMING' THEN 0.80 ELSE 1.0 END"),
    "exploratory": ("CASE regime WHEN 'PRODUCTIVE' THEN 1.0 WHEN 'RIGID' THEN 0.92 WHEN 'UNSTABLE' THEN 0.95 ELSE 1.0 END",
                    "CASE state WHEN 'REACTIVATING' THEN 1.08 WHEN 'ACTIVE' THEN 1.02 WHEN 'DORMANT' THEN 0.96 WHEN 'TENSIONED' THEN 0.95 WHEN 'STABLE' THEN 0.98 ELSE 1.0 END"),
}

#: Branches with their stated scalars and the centroid of their nodes, scored for the query.
def scored(mode: str, joined: str = "", trust: str = "0.30 * coherence + 0.20 * compression_loss - 0.25 * topic_drift_density + 0.25 * retrieval_error") -> str:
    r, s = _F[mode]
    return f"""{NODES}, {QUERY},
semq AS (SELECT branch_id, sum(qv * m) / ((sqrt(sum(qv * qv)) + {EPS}) * (sqrt(sum(m * m)) + {EPS})) AS sem FROM mu JOIN q USING (i) GROUP BY 1),
st AS (SELECT {k('branch_id')} AS branch_id, state, regime, coherence, compression_loss, topic_drift_density, retrieval_error, usefulness, reactivation_score, node_count, last_update_ts FROM branch_states),
sc AS (SELECT *, {trust} AS trust, 0.5 * sem AS react,
  greatest(0.25, least(1.5, ({r}) * ({s}))) AS factor FROM st JOIN semq USING (branch_id) {joined}),
tot AS (SELECT *, (0.60 * sem + 0.25 * trust + 0.15 * react) * factor AS total FROM sc)"""


#: Events read as feedback on branches.
FEEDBACK = """fb AS (SELECT event_id AS seq, event_id // 4 AS query_id, 'conv_' || CAST(user_id % 10 AS VARCHAR) AS branch_id, event_type IN ('click', 'purchase') AS used, event_type = 'error' AS corrected,
  event_type = 'view' AS expanded, CASE WHEN event_type = 'signup' THEN least(1.0, value / 500) END AS sig, epoch_us(ts) / 1e6 AS t FROM events)"""

#: For every pair of branches the newest 5,000 rows of both; queries that retrieved both over those that retrieved either.
CO_USE = f"""WITH {FEEDBACK}, names AS (SELECT DISTINCT branch_id FROM fb),
pr AS (SELECT a.branch_id AS a, b.branch_id AS b FROM names a JOIN names b ON a.branch_id < b.branch_id),
rows AS (SELECT pr.a, pr.b, fb.branch_id, query_id, used FROM pr JOIN fb ON fb.branch_id IN (pr.a, pr.b) QUALIFY row_number() OVER (PARTITION BY pr.a, pr.b ORDER BY t DESC, seq DESC) <= 5000),
per AS (SELECT a, b, query_id, max(CASE WHEN used THEN 1 ELSE 0 END) FILTER (branch_id = a) AS ua, max(CASE WHEN used THEN 1 ELSE 0 END) FILTER (branch_id = b) AS ub FROM rows GROUP BY 1, 2, 3)
SELECT a AS branch_a, b AS branch_b, count(*) FILTER (ua IS NOT NULL AND ub IS NOT NULL) AS shared, count(*) AS queries,
  greatest(0, least(1, count(*) FILTER (ua IS NOT NULL AND ub IS NOT NULL) / count(*) * (0.5 + 0.5 * avg((ua + ub) / 2.0)))) AS co FROM per GROUP BY 1, 2 HAVING shared > 0"""
