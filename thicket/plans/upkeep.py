"""Queries on the upkeep of the memory: split traces, merge counters, clean-up after deduplication, defaults, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.functions import codec, times
from thicket.functions import vectors as V
from thicket.functions.keys import key
from thicket.operators import integrity
from thicket.plans import branches, messages
from thicket.plans import sqlkit as Q
from thicket.plans.branches import DIM, nodes, states
from thicket.session import Scratch, table
from thicket.sources.store import Store
from thicket.streaming import poll

_R = lambda c: F.round(c, 6)

#: States and regimes there are (fixed values).
STATES = ("FORMING", "ACTIVE", "TENSIONED", "STABLE", "DORMANT", "REACTIVATING", "SPLIT_PENDING", "MERGE_CANDIDATE", "COLLAPSING")
REGIMES = ("PRODUCTIVE", "RIGID", "UNSTABLE")


def branch_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT4: scalars of branches with defaults for what is missing or names no state or regime."""
    b = states(spark, sf_dir)
    valid = lambda c, known, default: F.when(F.col(c).isin(*known), F.col(c)).otherwise(default).alias(c)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return b.select(
        "branch_id", F.coalesce("branch_type", F.lit("default")).alias("branch_type"), valid("state", STATES, "FORMING"), valid("regime", REGIMES, "PRODUCTIVE"),
        *[zero(c) for c in ("node_count", "split_counter", "merge_counter")], *[_R(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in ("eff_rank", "coherence", "usefulness", "last_update_ts")],
    )


def _gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cycle of upkeep observes of the split of each branch: score, gates, counter and reason."""
    cfg = Config()
    real = nodes(spark, sf_dir).where(V.usable(F.col("embedding"), DIM)).groupBy("branch_id").agg(F.count(F.lit(1)).alias("real_nodes"))
    s = states(spark, sf_dir).join(real, "branch_id", "left").withColumn("real_nodes", F.coalesce("real_nodes", F.lit(0))).withColumn("split_score", _R(branches._split_score(cfg)))
    enough = (F.col("node_count") >= cfg.split_min_nodes) & (F.col("real_nodes") >= cfg.split_min_nodes)
    above = F.col("split_score") > cfg.split_threshold
    counter = F.when(~enough, F.lit(0)).when(above, F.col("split_counter") + 1).otherwise(F.greatest(F.col("split_counter") - 1, F.lit(0)))
    s = s.withColumns({"gate_nodes": enough, "gate_score": above, "counter": counter})
    s = s.withColumn("gate_hysteresis", F.col("counter") >= cfg.split_hysteresis)
    return s.withColumn("should_split", F.col("gate_nodes") & F.col("gate_score") & F.col("gate_hysteresis"))


def split_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK12, FLT17: one row of trace for each branch, with the rank of the five that are enqueued."""
    g = _gates(spark, sf_dir)
    best = g.where("should_split").orderBy(F.col("split_score").desc(), "branch_id").limit(Config().split_enqueues)
    best = best.select("branch_id", F.row_number().over(Window.orderBy(F.col("split_score").desc(), "branch_id")).cast("long").alias("rank"))
    g = g.join(F.broadcast(best), "branch_id", "left")
    reset = ~F.col("gate_nodes") & (F.col("split_counter") != 0)
    reason = F.array_join(F.array_compact(F.array(
        F.when(~F.col("gate_nodes"), "nodes_below_min"), F.when(reset, "counter_reset_for_nodes_gate"), F.when(~F.col("gate_score"), "score_below_threshold"),
        F.when(F.col("gate_nodes") & F.col("gate_score") & ~F.col("gate_hysteresis"), "hysteresis_not_met"),
        F.when(F.col("rank").isNotNull(), F.concat(F.lit("eligible_enqueued_rank:"), F.col("rank").cast("string"))).when(F.col("should_split"), "eligible_throttled"),
    )), ";")
    return g.select("branch_id", "state", "node_count", "real_nodes", "split_score", "gate_nodes", "gate_score", "gate_hysteresis", "should_split", F.col("counter").cast("long").alias("split_counter"), F.col("rank").isNotNull().alias("enqueued"), reason.alias("reason"))


def split_trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: how many branches passed each gate in a run."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    has = lambda text: F.contains("reason", F.lit(text))
    return split_observations(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("obs_total"), *[n(F.col(c)).alias(f"{c}_true") for c in ("gate_nodes", "gate_score", "gate_hysteresis", "should_split", "enqueued")],
        n(has("eligible_candidate")).alias("candidate_count"), n(has("eligible_throttled")).alias("throttled_count"), n(has("eligible_pending_exists")).alias("pending_exists_count"), n(has("eligible_enqueued_rank:")).alias("enqueued_ranked_count"),
    )


def merge_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET1: settled branches whose merge counter falls by one: those with a counter, without those with a pair above the threshold."""
    pairs = branches.merge_pairs(spark, sf_dir).where(F.col("merge_score") > Config().merge_threshold)
    hits = pairs.select(F.explode(F.array("branch_a", "branch_b")).alias("branch_id")).distinct()
    b = states(spark, sf_dir).where("state IN ('STABLE', 'DORMANT') AND merge_counter > 0")
    return b.join(hits, "branch_id", "left_anti").select("branch_id", (F.col("merge_counter") - 1).alias("merge_counter"))


def cleaned_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK23: edges per type after a clean-up: those of removed nodes gone, temporal and correcting ones built anew."""
    e = integrity.cleaned_edges(table(spark, sf_dir, "memory_edges"), nodes(spark, sf_dir), messages.duplicate_map(spark, sf_dir))
    return e.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src_id").alias("sources"))


def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN1: vectors that come back from JSON as they were, and rows whose text gives no vector."""
    v = table(spark, sf_dir, "memory_nodes").where(F.col("embedding").isNull() | ~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    back = codec.vector_of(codec.vector_text(F.col("embedding")))
    return v.select(F.col("embedding").isNull().alias("missing"), back.alias("b"), "embedding").groupBy("missing").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(F.col("b") == F.col("embedding"), F.lit(False)).cast("long")).alias("same"), F.sum((F.size("b") == 0).cast("long")).alias("empty")
    )


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN2: a number out of the payload of events, per type; unreadable payloads count as empty."""
    e = table(spark, sf_dir, "events").select("event_type", codec.payload(F.col("props"), "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count("k").alias("numbers"), F.coalesce(F.sum("k"), F.lit(0)).alias("total"))


def branch_types_of_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO16: the type that each kind of node gives a branch it begins."""
    from thicket.operators import ingest

    return table(spark, sf_dir, "memory_nodes").groupBy("node_type", ingest.inferred_type(F.col("node_type")).alias("branch_type")).agg(F.count(F.lit(1)).alias("nodes"))


def stored_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1-3, SNK7-8, SNK20: branches written to a store, some patched, one added, some deleted, the rest counted per state."""
    store = Store(spark, Scratch(spark, "store").root, buckets=8)
    b = states(spark, sf_dir).select("branch_id", "state", "usefulness", "node_count").where("branch_id IS NOT NULL")
    store.replace("branches", b, ["branch_id"])
    store.patch("branches", b.where("state = 'STABLE'").select("branch_id", F.lit(0.25).alias("usefulness")), ["branch_id"])
    new = spark.createDataFrame([("conv_new", "FORMING", 0.5, 1), ("conv_1", "ACTIVE", 0.75, 2)], "branch_id string, state string, usefulness double, node_count long")
    store.upsert("branches", new, ["branch_id"])
    store.delete("branches", b.where("branch_id LIKE 'day%'").select("branch_id"), ["branch_id"])
    return store.read("branches").groupBy("state").agg(F.count(F.lit(1)).alias("branches"), F.sum("node_count").alias("nodes"), _R(F.avg("usefulness")).alias("avg_usefulness"))


def polled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3, STM1, STM3-4, SNK19, SNK24: a stream over all messages taken into a store exactly once, with what could not be taken."""
    scratch = Scratch(spark, "polled").root
    store = Store(spark, f"{scratch}/store", buckets=8)
    poll.poll(spark, f"{sf_dir}/messages.parque[t]", store, f"{scratch}/checkpoint").awaitTermination()
    bad, polls = store.read("dead_letter"), store.read("polls")
    out = store.read("messages").agg(F.count(F.lit(1)).alias("value")).select(F.lit("stored").alias("measure"), "value")
    dead = bad.agg(F.count(F.lit(1)).alias("value")).select(F.lit("dead_letters").alias("measure"), "value")
    seen = polls.agg(F.sum("polled").alias("polled"), F.max("last_seq").alias("last_seq")).select(F.explode(F.create_map(F.lit("polled"), F.col("polled"), F.lit("last_seq"), F.col("last_seq"))).alias("measure", "value"))
    return out.unionByName(dead).unionByName(seen)


def activity_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM2: messages and tokens of every conversation per hour of source time, as the stream of windows gives them."""
    return poll.activity_windows(table(spark, sf_dir, "messages").where("created_at IS NOT NULL")).fillna(0, ["tokens"])


def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC6: usable vectors per kind of node, and how many have length one after normalisation."""
    v = table(spark, sf_dir, "memory_nodes").where(V.usable(F.col("embedding"), DIM)).select("node_type", V.unit(V.doubles("embedding")).alias("u"))
    return v.groupBy("node_type").agg(F.count(F.lit(1)).alias("vectors"), F.sum((F.abs(V.norm(F.col("u")) - 1) < 1e-9).cast("long")).alias("unit"))


def coerced_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC12, DAT1, FLT8: times given as text in seconds and in milliseconds read back, and how many lie within bounds."""
    m = table(spark, sf_dir, "messages").where("created_at IS NOT NULL").select(F.floor("created_at").cast("long").alias("s"))
    read = m.select("s", times.epoch(F.col("s").cast("string")).alias("a"), times.epoch((F.col("s") * 1000).cast("string")).alias("b"), times.epoch(F.concat(F.lit("x"), F.col("s").cast("string"))).alias("c"))
    inside = times.in_bounds(F.col("a"), 1764547200.0, 1767225600.0)
    return read.agg(F.count(F.lit(1)).alias("times"), F.sum((F.col("a") == F.col("s")).cast("long")).alias("seconds"), F.sum((F.col("b") == F.col("s")).cast("long")).alias("millis"), F.count("c").alias("unreadable_read"), F.sum(inside.cast("long")).alias("inside"))


QUERIES = {
    f.__name__: f
    for f in (branch_defaults, split_observations, split_trace_summary, merge_decay, cleaned_edges, vector_round_trip, event_payloads, branch_types_of_nodes, stored_branches, polled_messages, activity_by_hour, unit_vectors, coerced_times)
}

_B, _ID = Q.k("branch_id"), Q.k("id")
_in = lambda xs: ", ".join(f"'{x}'" for x in xs)
_OBS = f"""WITH {Q.NODES}, real AS (SELECT branch_id AS rb, n FROM size),
g AS (SELECT {_B} AS branch_id, state, node_count, coalesce(n, 0) AS real_nodes, split_counter AS c0, round(0.15 * (1 - coherence) + 0.20 * anisotropy + 0.20 * compression_loss + 0.20 * retrieval_error + 0.25 * topic_drift_density, 6) AS split_score
  FROM branch_states LEFT JOIN real ON rb = {_B}),
h AS (SELECT *, node_count >= {Config().split_min_nodes} AND real_nodes >= {Config().split_min_nodes} AS gate_nodes, split_score > {Config().split_threshold} AS gate_score FROM g),
k AS (SELECT *, CASE WHEN NOT gate_nodes THEN 0 WHEN gate_score THEN c0 + 1 ELSE greatest(c0 - 1, 0) END AS c1 FROM h),
l AS (SELECT *, c1 >= {Config().split_hysteresis} AS gate_hysteresis, gate_nodes AND gate_score AND c1 >= {Config().split_hysteresis} AS should_split FROM k),
m AS (SELECT *, CASE WHEN should_split THEN row_number() OVER (PARTITION BY should_split ORDER BY split_score DESC, branch_id) END AS r FROM l),
o AS (SELECT branch_id, state, node_count, real_nodes, split_score, gate_nodes, gate_score, gate_hysteresis, should_split, CAST(c1 AS BIGINT) AS split_counter, coalesce(r <= {Config().split_enqueues}, false) AS enqueued,
  concat_ws(';', CASE WHEN NOT gate_nodes THEN 'nodes_below_min' END, CASE WHEN NOT gate_nodes AND c0 <> 0 THEN 'counter_reset_for_nodes_gate' END, CASE WHEN NOT gate_score THEN 'score_below_threshold' END,
  CASE WHEN gate_nodes AND gate_score AND NOT gate_hysteresis THEN 'hysteresis_not_met' END, CASE WHEN r <= {Config().split_enqueues} THEN 'eligible_enqueued_rank:' || CAST(r AS VARCHAR) WHEN should_split THEN 'eligible_throttled' END) AS reason FROM m)"""

ORACLE = {
    "stored_branches": f"""WITH b AS (SELECT {_B} AS b, state, CASE WHEN state = 'STABLE' THEN 0.25 ELSE usefulness END AS u, node_count AS n FROM branch_states WHERE {_B} IS NOT NULL),
r AS (SELECT * FROM b WHERE b NOT IN ('conv_1', 'conv_new') AND b NOT LIKE 'day%' UNION ALL SELECT 'conv_new', 'FORMING', 0.5, 1 UNION ALL SELECT 'conv_1', 'ACTIVE', 0.75, 2)
SELECT state, count(*) AS branches, CAST(sum(n) AS BIGINT) AS nodes, round(avg(u), 6) AS avg_usefulness FROM r GROUP BY 1""",
    "polled_messages": f"""SELECT 'stored' AS measure, count(DISTINCT {Q.k('message_id')}) AS value FROM messages UNION ALL SELECT 'dead_letters', count(*) FILTER ({Q.k('message_id')} IS NULL) FROM messages
UNION ALL SELECT 'polled', count(*) FROM messages UNION ALL SELECT 'last_seq', max(ingest_seq) FROM messages""",
    "activity_by_hour": "SELECT CAST(floor(created_at / 3600) AS BIGINT) * 3600 AS window_start, conversation_id, count(*) AS messages, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM messages WHERE conversation_id IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2",
    "unit_vectors": f"SELECT node_type, count(*) AS vectors, count(*) AS unit FROM memory_nodes WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0 GROUP BY 1",
    "coerced_times": """SELECT count(*) AS times, count(*) AS seconds, count(*) AS millis, 0 AS unreadable_read, count(*) FILTER (floor(created_at) BETWEEN 1764547200 AND 1767225600) AS inside FROM messages WHERE created_at IS NOT NULL""",
    "branch_defaults": f"""SELECT {_B} AS branch_id, coalesce(branch_type, 'default') AS branch_type, CASE WHEN state IN ({_in(STATES)}) THEN state ELSE 'FORMING' END AS state, CASE WHEN regime IN ({_in(REGIMES)}) THEN regime ELSE 'PRODUCTIVE' END AS regime,
  {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('node_count', 'split_counter', 'merge_counter'))}, {', '.join(f'round(coalesce({c}, 0), 6) AS {c}' for c in ('eff_rank', 'coherence', 'usefulness', 'last_update_ts'))} FROM branch_states""",
    "split_observations": f"{_OBS} SELECT * FROM o",
    "split_trace_summary": f"""{_OBS} SELECT count(*) AS obs_total, {', '.join(f'count(*) FILTER ({c}) AS {c}_true' for c in ('gate_nodes', 'gate_score', 'gate_hysteresis', 'should_split', 'enqueued'))},
  {', '.join(f"count(*) FILTER (reason LIKE '%{text}%') AS {name}" for text, name in (('eligible_candidate', 'candidate_count'), ('eligible_throttled', 'throttled_count'), ('eligible_pending_exists', 'pending_exists_count'), ('eligible_enqueued_rank:', 'enqueued_ranked_count')))} FROM o""",
    "merge_decay": f"""WITH p AS ({branches.ORACLE['merge_pairs']}) SELECT {_B} AS branch_id, merge_counter - 1 AS merge_counter FROM branch_states WHERE state IN ('STABLE', 'DORMANT') AND merge_counter > 0
AND {_B} NOT IN (SELECT branch_a FROM p WHERE merge_score > {Config().merge_threshold} UNION SELECT branch_b FROM p WHERE merge_score > {Config().merge_threshold})""",
    "cleaned_edges": f"""WITH {messages._DUP}, left_ AS (SELECT * FROM memory_nodes WHERE ingest_seq NOT IN (SELECT ingest_seq FROM dup)), gone AS (SELECT DISTINCT id FROM dup WHERE id NOT IN (SELECT {_ID} FROM left_ WHERE {_ID} IS NOT NULL)),
{messages._ORD.replace('FROM memory_nodes', 'FROM left_')},
old AS (SELECT {Q.k('src_id')} AS src_id, edge_type FROM memory_edges WHERE edge_type NOT IN ('temporal_next', 'refines', 'contradicts', 'supersedes') AND {Q.k('src_id')} NOT IN (SELECT id FROM gone) AND {Q.k('dst_id')} NOT IN (SELECT id FROM gone)),
om AS (SELECT {_B} AS b, id, ingest_seq, update_mode, lag(id) OVER (PARTITION BY {_B} ORDER BY coalesce("timestamp", 0), ingest_seq) AS prev FROM left_ WHERE {_B} IS NOT NULL AND node_type = 'message'),
every AS (SELECT * FROM old UNION ALL SELECT {Q.k('prev')}, 'temporal_next' FROM o WHERE prev IS NOT NULL
  UNION ALL SELECT {_ID}, CASE update_mode WHEN 'refine' THEN 'refines' WHEN 'contradict' THEN 'contradicts' ELSE 'supersedes' END FROM om WHERE prev IS NOT NULL AND update_mode IN ('refine', 'contradict', 'supersede'))
SELECT edge_type, count(*) AS edges, count(DISTINCT src_id) AS sources FROM every GROUP BY 1""",
    "vector_round_trip": """SELECT embedding IS NULL AS missing, count(*) AS rows, CAST(sum(CASE WHEN embedding IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS same, CAST(sum(CASE WHEN coalesce(len(embedding), 0) = 0 THEN 1 ELSE 0 END) AS BIGINT) AS empty
FROM memory_nodes WHERE embedding IS NULL OR len(list_filter(embedding, lambda v: isnan(v) OR isinf(v))) = 0 GROUP BY 1""",
    "event_payloads": "WITH e AS (SELECT event_type, TRY_CAST(json_extract_string(CASE WHEN json_valid(props) THEN props ELSE '{}' END, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(*) AS events, count(k) AS numbers, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM e GROUP BY 1",
    "branch_types_of_nodes": "SELECT node_type, CASE node_type WHEN 'message' THEN 'broad_history' WHEN 'tool_result' THEN 'project_task' ELSE 'default' END AS branch_type, count(*) AS nodes FROM memory_nodes GROUP BY 1, 2",
}
