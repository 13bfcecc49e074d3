"""Queries on how branches evolve: drift, running means, allocation, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import embed
from thicket.functions import vectors as V
from thicket.functions.keys import key
from thicket.operators import drift, geometry, ingest
from thicket.plans import sqlkit as Q
from thicket.plans import branches
from thicket.plans.branches import DIM, nodes, states
from thicket.session import Scratch, table

_R = lambda c: F.round(c, 6)


def _drift_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where(V.usable(F.col("embedding"), DIM)).select("branch_id", "id", "timestamp", "ingest_seq", "role", "token_count", "embedding", key("lcm_id").alias("k"))
    chars = F.max(F.length(F.trim(F.coalesce("content", F.lit("")))))
    m = table(spark, sf_dir, "messages").groupBy(key("message_id").alias("k")).agg(chars.alias("chars"))
    return n.join(m, "k", "left").withColumn("chars", F.coalesce("chars", F.lit(-1))).drop("k")


def topic_drift_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC8, JOIN16, WIN8: share of opposite pairs among eligible ones in the sample of each branch."""
    d = drift.found(drift.sample(_drift_nodes(spark, sf_dir), 192))
    return d.select("branch_id", "eligible", "drifting", _R(F.col("drifting") / F.col("eligible")).alias("density"))


def topic_drift_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP9: the most opposite pairs of each branch as weighted edges."""
    e = drift.found(drift.sample(_drift_nodes(spark, sf_dir), 192)).select("branch_id", F.explode("edges").alias("e"))
    e = e.select("branch_id", V.clamp(0.5 * (1 - F.col("e.sim"))).alias("weight"))
    return e.groupBy("branch_id").agg(F.count(F.lit(1)).alias("edges"), _R(F.max("weight")).alias("heaviest"), _R(F.sum("weight")).alias("weight"))


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN8-10: 16 evenly spaced nodes of every branch."""
    return drift.sample(nodes(spark, sf_dir).select("branch_id", "id", "timestamp", "ingest_seq"), 16).select("branch_id", "ingest_seq", "place")


def adiabatic_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN11: the slowly moving mean of every branch after all its nodes, in closed form."""
    m = ingest.running_mean(nodes(spark, sf_dir).select("branch_id", "id", "timestamp", "ingest_seq", "embedding"), DIM)
    return m.select("branch_id", "n", F.posexplode("mean_vec").alias("dim", "v")).select("branch_id", "n", (F.col("dim") + 1).cast("long").alias("dim"), _R("v").alias("mean"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = nodes(spark, sf_dir).where(V.usable(F.col("embedding"), DIM)).join(states(spark, sf_dir).select("branch_id", "branch_type"), "branch_id", "left")
    return n.select(
        F.col("ingest_seq").alias("item"), F.col("branch_id").alias("forced_branch"), F.col("embedding").alias("x"), F.coalesce("conflict_score", F.lit(0.0)).alias("conflict"),
        F.coalesce(F.lower(F.trim("branch_type")), ingest.inferred_type(F.col("node_type"))).alias("branch_type"),
    )


def forced_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM5, SCO1, SCO14, SCO16, GRF2: items of given branches folded in order, with their update mode and correction chain."""
    out = ingest.forced_fold(_items(spark, sf_dir))
    return out.select(
        "item", "branch_id", "action", F.round(F.log1p("score"), 5).alias("log_score"), _R("sim").alias("sim"), "update_mode",
        F.coalesce("prev_item", F.lit(-1)).alias("prev_item"), F.coalesce("root_item", F.lit(-1)).alias("root_item"), "version", _R("anchor_drift").alias("anchor_drift"),
    )


def free_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM5, SCO1-2, TOP3: all usable nodes allocated to branches one after the other (serial by nature)."""
    n = nodes(spark, sf_dir).where(V.usable(F.col("embedding"), DIM))
    items = n.select(F.col("ingest_seq").alias("item"), V.doubles("embedding").alias("x"), F.coalesce("conflict_score", F.lit(0.0)).alias("conflict"), ingest.inferred_type(F.col("node_type")).alias("branch_type"), F.col("timestamp").alias("ts"))
    return ingest.free_fold(items)


def split_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC7, GRF3: every branch of at least eight vectors cut in two by 2-means, with the sizes of its children."""
    s = ingest.split_branches(nodes(spark, sf_dir), DIM)
    return s.groupBy("branch_id", "child").agg(F.count(F.lit(1)).alias("nodes"), F.min("ingest_seq").alias("first_seq"))


def summary_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC4, VEC10: every summary node against the nodes it was made from (its ``summarizes`` and ``derived_from`` edges)."""
    vecs = nodes(spark, sf_dir).where(V.usable(F.col("embedding"), DIM))
    first = vecs.where(key("id").isNotNull()).groupBy(key("id").alias("k")).agg(F.min(F.struct("ingest_seq", "branch_id", "node_type", F.col("embedding").alias("x"))).alias("r")).select("k", "r.*")
    s = first.where(F.col("node_type").isin("leaf_summary", "condensed_summary")).select(F.col("k").alias("s"), "ingest_seq", "branch_id", V.doubles("x").alias("x"))
    e = table(spark, sf_dir, "memory_edges").where(F.col("edge_type").isin("summarizes", "derived_from")).select(key("src_id").alias("s"), key("dst_id").alias("k")).distinct()
    below = geometry.plain_sums(e.join(first.select("k", F.col("x").alias("y")), "k"), "s", "y", DIM)
    j = s.join(below, "s", "left")
    known = F.col("n").isNotNull()
    health, loss = geometry.summary_health(F.col("x"), F.col("mean_vec"), F.col("spread"))
    return j.select(
        "ingest_seq", "branch_id", F.coalesce("n", F.lit(0)).alias("descendants"), F.when(known, _R(loss)).otherwise(0.0).alias("loss"),
        F.when(known, _R(health)).otherwise(1.0).alias("health"), geometry.advice(F.when(known, health).otherwise(1.0)).alias("recommendation"),
    )


def executed_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF4: the five best merge jobs carried out: an edge of topic each way between the two branches, its weight the score within 0.05 ... 3."""
    best = branches.merge_pairs(spark, sf_dir).orderBy(F.col("merge_score").desc(), "branch_a", "branch_b").limit(5)
    return ingest.merge_edges(best)


def executed_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRF3: the ten best split jobs carried out: children with their nodes, the edge from the source, and their geometry."""
    n = nodes(spark, sf_dir)
    jobs = branches.split_score_rank(spark, sf_dir).orderBy(F.col("split_score").desc(), "branch_id").limit(10).select("branch_id")
    first = int(branches.next_branch_id(spark, sf_dir).first()["next_id"].removeprefix("conv_"))
    moved = Scratch(spark, "splits").save(ingest.children(ingest.split_branches(n.join(F.broadcast(jobs), "branch_id"), DIM), first), "moved")
    rows = n.join(moved.select("ingest_seq", "child_id"), "ingest_seq")
    geo = geometry.branch_geometry(rows.select(F.col("child_id").alias("branch_id"), "importance_score", "embedding"), DIM)
    edge = moved.groupBy("branch_id", "child_id").agg(F.count(F.lit(1)).alias("nodes"), F.min("ingest_seq").alias("first_seq"))
    out = edge.join(geo.select(F.col("branch_id").alias("child_id"), _R("coherence").alias("coherence"), _R("trace").alias("trace")), "child_id")
    return out.select(F.col("branch_id").alias("src_id"), F.col("child_id").alias("dst_id"), F.lit("refines").alias("edge_type"), "nodes", "first_seq", "coherence", "trace")


def embedded_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF1-4: message texts embedded by the hashing provider; non-zero places of each vector."""
    m = table(spark, sf_dir, "messages").where("content IS NOT NULL").select("ingest_seq", embed.embed("content", DIM).alias("v"))
    return m.select("ingest_seq", F.size(F.filter("v", lambda x: x != 0)).alias("non_zero"), F.round(V.norm(V.doubles("v")), 3).alias("norm"))


QUERIES = {
    f.__name__: f
    for f in (topic_drift_density, topic_drift_edges, stratified_sample, adiabatic_mean, forced_ingest, free_allocation, split_children, summary_health, executed_merges, executed_splits, embedded_messages)
}

_B = Q.k("branch_id")
_SAMPLE = f"""o AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY coalesce(t, 0), s) - 1 AS r, count(*) OVER (PARTITION BY b) AS n FROM src),
pick AS (SELECT DISTINCT b, n, CASE WHEN n <= K THEN j ELSE CAST(floor(j * ((n - 1) / (K - 1.0)) + 1e-9) AS BIGINT) END AS r FROM (SELECT DISTINCT b, n FROM o), range(K) AS g(j) WHERE j < n),
pl AS (SELECT b, r, row_number() OVER (PARTITION BY b ORDER BY r) - 1 AS place FROM pick),
smp AS (SELECT o.*, place FROM o JOIN pl USING (b, r))"""
_PAIRS = f"""WITH {Q.NODES}, msg AS (SELECT {Q.k('message_id')} AS k, max(length(trim(coalesce(content, '')))) AS chars FROM messages GROUP BY 1),
src AS (SELECT n.branch_id AS b, m.id, m."timestamp" AS t, n.ingest_seq AS s, m.role, m.token_count, coalesce(chars, -1) AS chars, n.x FROM nodes n JOIN memory_nodes m USING (ingest_seq) LEFT JOIN msg ON msg.k = {Q.k('m.lcm_id')} WHERE n.branch_id IS NOT NULL),
{_SAMPLE.replace('K', '192')},
ok AS (SELECT * FROM smp WHERE role IN ('assistant', 'user') AND token_count >= 8 AND chars >= 30),
pr AS (SELECT a.b, c.id AS newer, a.id AS older, list_inner_product(a.x, c.x) / ((sqrt(list_inner_product(a.x, a.x)) + 1e-9) * (sqrt(list_inner_product(c.x, c.x)) + 1e-9)) AS sim FROM ok a JOIN ok c ON a.b = c.b AND c.place - a.place >= 48)"""

ORACLE = {
    "topic_drift_density": f"{_PAIRS} SELECT b AS branch_id, count(*) AS eligible, count(*) FILTER (sim < 0) AS drifting, round(count(*) FILTER (sim < 0) / count(*), 6) AS density FROM pr GROUP BY 1",
    "topic_drift_edges": f"""{_PAIRS}, e AS (SELECT b, greatest(0, least(1, 0.5 * (1 - sim))) AS w FROM pr WHERE sim < 0 QUALIFY row_number() OVER (PARTITION BY b ORDER BY sim, newer, older) <= 256)
SELECT b AS branch_id, count(*) AS edges, round(max(w), 6) AS heaviest, round(sum(w), 6) AS weight FROM e GROUP BY 1""",
    "stratified_sample": f"""WITH src AS (SELECT {_B} AS b, "timestamp" AS t, ingest_seq AS s FROM memory_nodes WHERE {_B} IS NOT NULL), {_SAMPLE.replace('K', '16')} SELECT b AS branch_id, s AS ingest_seq, place FROM smp""",
    "adiabatic_mean": f"""WITH {Q.NODES}, r AS (SELECT n.branch_id AS b, n.ingest_seq, row_number() OVER w AS k, count(*) OVER (PARTITION BY n.branch_id) AS n FROM nodes n JOIN memory_nodes m USING (ingest_seq) WHERE n.branch_id IS NOT NULL
  WINDOW w AS (PARTITION BY n.branch_id ORDER BY coalesce(m."timestamp", 0), n.ingest_seq)),
l AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE ln(1 - 0.05 / k) END AS f FROM r), c AS (SELECT *, sum(f) OVER (PARTITION BY b) - sum(f) OVER (PARTITION BY b ORDER BY k) AS after FROM l)
SELECT b AS branch_id, any_value(n) AS n, CAST(i AS BIGINT) AS dim, round(sum(v * CASE WHEN k = 1 THEN 1 ELSE 0.05 / k END * exp(after)), 6) AS mean FROM c JOIN long USING (ingest_seq) GROUP BY 1, 3""",
    "forced_ingest": f"""WITH {Q.NODES}, ty AS (SELECT {_B} AS branch_id, lower(trim(branch_type)) AS ty FROM branch_states),
r AS (SELECT n.branch_id AS b, n.ingest_seq AS item, coalesce(m.conflict_score, 0) AS f, row_number() OVER w AS k, coalesce(ty, CASE m.node_type WHEN 'message' THEN 'broad_history' WHEN 'tool_result' THEN 'project_task' ELSE 'default' END) AS ty
  FROM nodes n JOIN memory_nodes m USING (ingest_seq) LEFT JOIN ty ON ty.branch_id = n.branch_id WHERE n.branch_id IS NOT NULL WINDOW w AS (PARTITION BY n.branch_id ORDER BY n.ingest_seq)),
p AS (SELECT *, exp(sum(CASE WHEN k = 1 THEN 0 ELSE ln(1 - 0.05 / k) END) OVER (PARTITION BY b ORDER BY k)) AS p FROM r),
c AS (SELECT p.*, i, v, sum(CASE WHEN k = 1 THEN 1 ELSE 0.05 / k END * v / p) OVER (PARTITION BY b, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, lag(p) OVER (PARTITION BY b, i ORDER BY k) AS p0 FROM p JOIN long ON long.ingest_seq = p.item),
m AS (SELECT *, coalesce(p0 * s, 0) AS mean, ((k - 1) * coalesce(p0 * s, 0) + v) / k AS m FROM c),
an AS (SELECT *, lag(CASE WHEN k = 1 THEN v ELSE NULL END) OVER (PARTITION BY b, i ORDER BY k) AS x, pow(0.99, k - 2) * sum(CASE WHEN k = 1 THEN v ELSE 0.01 * m / pow(0.99, k - 1) END) OVER (PARTITION BY b, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS anchor FROM m),
d AS (SELECT b, item, any_value(k) AS k, any_value(f) AS f, any_value(ty) AS ty, sum(v * mean) / ((sqrt(sum(v * v)) + 1e-9) * (sqrt(sum(mean * mean)) + 1e-9)) AS sim, sqrt(sum((m - mean) * (m - mean))) AS mu,
  sum((v - m) * (v - m) / k) AS trace, max((v - m) * (v - m) / k) AS mx, 0.01 * sqrt(sum((m - anchor) * (m - anchor))) AS drift FROM an GROUP BY 1, 2),
rk AS (SELECT an.item, exp(-sum(CASE WHEN q > 1e-9 THEN q * ln(q + 1e-9) ELSE 0 END)) AS er FROM (SELECT an.item, (v - m) * (v - m) / an.k / (trace + 1e-9) AS q FROM an JOIN d USING (item)) an GROUP BY 1),
z AS (SELECT d.*, CASE WHEN k > 1 AND mu > 1e-12 THEN mu ELSE 0 END AS d1, CASE WHEN k > 1 AND abs(er - 1) > 1e-12 THEN abs(er - 1) ELSE 0 END AS d2, CASE WHEN k > 1 AND mx / (trace + 1e-9) > 1e-12 THEN mx / (trace + 1e-9) ELSE 0 END AS d3,
  CASE WHEN k > 1 AND trace > 1e-12 THEN trace ELSE 0 END AS d4 FROM d JOIN rk USING (item)),
g AS (SELECT *, {', '.join(f'min(CASE WHEN d{j} > 0 THEN k END) OVER (PARTITION BY b) AS f{j}' for j in (1, 2, 3, 4))} FROM z),
e AS (SELECT *, {', '.join(f'coalesce(pow(0.95, k - 1) * sum(CASE WHEN k = f{j} THEN d{j} WHEN k > f{j} THEN 0.05 * d{j} ELSE 0 END / pow(0.95, k)) OVER (PARTITION BY b ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e{j}' for j in (1, 2, 3, 4))} FROM g),
sc AS (SELECT *, CASE WHEN k = 1 THEN 0 ELSE sim END AS si, CASE WHEN k = 1 THEN 0 ELSE 0.15 * (1 - sim) + 0.20 * f + 0.15 * d1 / (e1 + 1e-9) + 0.10 * d2 / (e2 + 1e-9) + 0.15 * d3 / (e3 + 1e-9) + 0.10 * d4 / (e4 + 1e-9) END AS score,
  CASE WHEN k = 1 THEN 'fork' WHEN ty IN ('identity', 'user_fact', 'user_preference', 'preference') AND f >= 0.70 AND sim >= 0.78 THEN 'supersede' WHEN f >= 0.25 THEN 'contradict' WHEN sim >= 0.92 OR (f <= 0 AND sim >= 0.5) THEN 'refine' ELSE 'attach' END AS mode FROM e),
ch AS (SELECT *, mode IN ('refine', 'contradict', 'supersede') AS linked, lag(item) OVER (PARTITION BY b ORDER BY k) AS prev, max(CASE WHEN mode NOT IN ('refine', 'contradict', 'supersede') THEN k END) OVER (PARTITION BY b ORDER BY k) AS rk FROM sc)
SELECT ch.item, ch.b AS branch_id, CASE WHEN ch.k = 1 THEN 'fork' ELSE 'attach' END AS action, round(ln(1 + score), 5) AS log_score, round(si, 6) AS sim, mode AS update_mode, CASE WHEN linked THEN ch.prev ELSE -1 END AS prev_item,
  CASE WHEN linked THEN t.item ELSE -1 END AS root_item, CASE WHEN linked THEN ch.k - rk + 1 ELSE 1 END AS version, round(CASE WHEN ch.k = 1 THEN 0 ELSE drift END, 6) AS anchor_drift FROM ch JOIN r t ON t.b = ch.b AND t.k = ch.rk""",
    "summary_health": f"""WITH {Q.NODES}, first AS (SELECT {Q.k('m.id')} AS k, m.node_type, n.* FROM nodes n JOIN memory_nodes m USING (ingest_seq) WHERE {Q.k('m.id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {Q.k('m.id')} ORDER BY ingest_seq) = 1),
e AS (SELECT DISTINCT {Q.k('src_id')} AS s, {Q.k('dst_id')} AS k FROM memory_edges WHERE edge_type IN ('summarizes', 'derived_from')),
fl AS (SELECT k, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM first),
dm AS (SELECT s, i, count(*) AS n, sum(v) / (count(*) + 1e-9) AS m FROM e JOIN fl USING (k) GROUP BY 1, 2),
dv AS (SELECT s, any_value(n) AS n, avg((v - m) * (v - m)) AS spread FROM e JOIN fl USING (k) JOIN dm USING (s, i) GROUP BY 1),
c AS (SELECT s, sum(v * m) / ((sqrt(sum(v * v)) + 1e-9) * (sqrt(sum(m * m)) + 1e-9)) AS cos FROM dm JOIN fl ON fl.k = dm.s AND fl.i = dm.i GROUP BY 1),
h AS (SELECT f.ingest_seq, f.branch_id, coalesce(n, 0) AS descendants, CASE WHEN n IS NULL THEN 0 ELSE 0.6 * (1 - cos) + 0.4 * least(abs(ln(greatest(spread, 1e-9)) - ln(2e-9)) / 10, 1) END AS loss, cos FROM first f LEFT JOIN dv ON dv.s = f.k LEFT JOIN c ON c.s = f.k
  WHERE f.node_type IN ('leaf_summary', 'condensed_summary')),
g AS (SELECT *, CASE WHEN descendants = 0 THEN 1.0 ELSE 0.05 * cos + 0.05 * loss END AS health FROM h)
SELECT ingest_seq, branch_id, descendants, round(loss, 6) AS loss, round(health, 6) AS health, CASE WHEN health > 0.70 THEN 'healthy' WHEN health > 0.45 THEN 'refine' ELSE 'split_or_prevent_condensation' END AS recommendation FROM g""",
    "executed_merges": f"""WITH b AS (SELECT * FROM ({branches.ORACLE['merge_pairs']}) ORDER BY merge_score DESC, branch_a, branch_b LIMIT 5)
SELECT branch_a AS src_id, branch_b AS dst_id, 'same_topic' AS edge_type, greatest(0.05, least(3.0, merge_score)) AS weight FROM b UNION ALL SELECT branch_b, branch_a, 'same_topic', greatest(0.05, least(3.0, merge_score)) FROM b""",
}
