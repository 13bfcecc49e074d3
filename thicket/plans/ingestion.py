"""Queries on what comes in and what comes out: backfill, totals, candidates, the combined search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.config import AS_OF, Config
from thicket.functions import times
from thicket.functions import vectors as V
from thicket.functions.keys import key
from thicket.operators import backfill, geometry, ingest, retrieval
from thicket.plans import branches, messages
from thicket.plans import sqlkit as Q
from thicket.plans.branches import DIM, nodes, states
from thicket.session import table

_R = lambda c: F.round(c, 6)


def backfill_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1-2: what a backfill does with every listed conversation: resume, empty or processed, with the messages it takes."""
    have = states(spark, sf_dir).where("node_count > 0").select("branch_id")
    return backfill.status(table(spark, sf_dir, "conversations"), table(spark, sf_dir, "messages"), have, per_conversation=200)


def backfill_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, WIN9-10: messages a backfill takes, at most 200 of a conversation, evenly spread in order."""
    m = table(spark, sf_dir, "messages").where("conversation_id IS NOT NULL")
    return backfill.stride_sample(m, "conversation_id", 200).select("conversation_id", "ingest_seq", "place")


def summary_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: vectors of summary nodes blended with the centroid of their branch's messages, 0.7 to 0.3."""
    n = nodes(spark, sf_dir)
    mean = geometry.branch_geometry(n.where("node_type = 'message'").select("branch_id", "importance_score", "embedding"), DIM).select("branch_id", "mean_vec")
    s = n.where(F.col("node_type").isin("leaf_summary", "condensed_summary") & V.usable(F.col("embedding"), DIM)).select("ingest_seq", "node_type", "branch_id", V.doubles("embedding").alias("x"))
    blended = F.zip_with("x", "mean_vec", lambda a, b: 0.7 * a + 0.3 * b)
    return s.join(mean, "branch_id").select("ingest_seq", "node_type", _R(V.norm(blended)).alias("norm"), _R(V.total(blended)).alias("total"))


def conversation_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6: geometry of every conversation from the vectors of its messages, at most 200 of them, each with weight one; the
    count is that of all its messages."""
    m = table(spark, sf_dir, "messages").where("conversation_id IS NOT NULL")
    total = m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"))
    picked = backfill.stride_sample(m, "conversation_id", 200).select("ingest_seq")
    keys = m.join(picked, "ingest_seq", "left_semi").select("conversation_id", key("message_id").alias("k")).where("k IS NOT NULL").distinct()
    n = nodes(spark, sf_dir).where(F.col("node_type").isin("message", "tool_result") & V.usable(F.col("embedding"), DIM))
    first = n.groupBy(key("lcm_id").alias("k")).agg(F.min(F.struct("ingest_seq", "embedding")).alias("r")).select("k", "r.embedding")
    g = geometry.branch_geometry(keys.join(first, "k").select("conversation_id", F.lit(1.0).alias("importance_score"), "embedding"), DIM, by="conversation_id")
    return g.join(total, "conversation_id").select("conversation_id", "messages", "n", F.lit("ACTIVE").alias("state"), F.lit("conversation").alias("branch_type"), *[_R(c).alias(c) for c in ("eff_rank", "trace", "coherence")])


def table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13, SRC14: rows of every table, with the last arrival number where there is one."""
    out = None
    for name, seq in (("memory_nodes", "ingest_seq"), ("memory_edges", "edge_seq"), ("messages", "ingest_seq"), ("branch_states", None), ("summaries", None), ("daily_log_content", None)):
        last = F.coalesce(F.max(seq), F.lit(0)) if seq else F.lit(0)
        part = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("rows"), last.cast("long").alias("last_seq")).select(F.lit(name).alias("name"), "rows", "last_seq")
        out = part if out is None else out.unionByName(part)
    return out


def conversation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT5, FLT11: conversation and day branches in working states that were active lately, the largest 100."""
    b = states(spark, sf_dir).where(F.col("branch_id").startswith("conv_") | F.col("branch_id").startswith("day_"))
    b = b.where(F.col("state").isin(retrieval.state_list(group="working"))).withColumn("activity", times.activity(F.col("last_update_ts"), AS_OF, 90.0))
    return b.where("activity = 'recent'").orderBy(F.col("node_count").desc(), "branch_id").limit(100).select("branch_id", "state", "node_count")


def new_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT13: messages that no node holds yet, per conversation."""
    have = nodes(spark, sf_dir).where("node_type IN ('message', 'tool_result')").select(key("lcm_id").alias("k")).distinct()
    m = table(spark, sf_dir, "messages").select(key("message_id").alias("k"), "conversation_id").where("k IS NOT NULL AND conversation_id IS NOT NULL").distinct()
    return m.join(have, "k", "left_anti").groupBy("conversation_id").agg(F.count(F.lit(1)).alias("new_messages"))


def update_mode_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO14: what every node does to its branch, from the branch's type, its similarity to the centroid and its conflict.

    Messages and tool results come with their branch named (forced); a node that began its branch stays a fork, and
    a branch without a row has no type.
    """
    cfg = Config()
    n = nodes(spark, sf_dir).where(V.usable(F.col("embedding"), DIM)).select("ingest_seq", "branch_id", "importance_score", "conflict_score", "node_type", "update_mode", "embedding")
    mean = geometry.branch_geometry(n.select("branch_id", "importance_score", "embedding"), DIM).select("branch_id", "mean_vec")
    types = states(spark, sf_dir).select("branch_id", "branch_type")
    j = n.join(mean.join(types, "branch_id", "left"), "branch_id").withColumn("sim", F.round(V.cosine(V.doubles("embedding"), F.col("mean_vec")), 6))
    forced = F.col("node_type").isin("message", "tool_result")
    mode = ingest.mode_of(F.coalesce(F.col("update_mode"), F.lit("attach")), F.col("branch_type"), F.col("sim"), F.coalesce("conflict_score", F.lit(0.0)), forced, cfg)
    return j.groupBy(mode.alias("mode"), F.coalesce(F.lower(F.trim("branch_type")), F.lit("none")).alias("branch_type")).agg(F.count(F.lit(1)).alias("nodes"), _R(F.avg("sim")).alias("avg_sim"))


def content_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR7: messages by length of their trimmed text."""
    n = F.length(F.trim(F.coalesce("content", F.lit(""))))
    size = F.when(n == 0, "empty").when(n < 30, "short").when(n < 300, "middle").otherwise("long")
    return table(spark, sf_dir, "messages").groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("messages"), F.sum(n).cast("long").alias("signs"))


def branch_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DAT2, FLT10: age labels of branches."""
    return states(spark, sf_dir).select("branch_id", times.age_label(F.col("last_update_ts"), AS_OF).alias("age"), times.activity(F.col("last_update_ts"), AS_OF).alias("activity"))


def daily_log_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN7: log entries nearest to the query vector."""
    q = F.array(*[F.lit(x) for x in branches.query_vector(spark, sf_dir)])
    logs = table(spark, sf_dir, "daily_log_content").select(key("node_id").alias("node_key"), "created_ts")
    n = nodes(spark, sf_dir).where(V.usable(F.col("embedding"), DIM)).select("branch_id", key("id").alias("node_key"), "ingest_seq", "embedding")
    best = logs.join(n, "node_key").withColumn("sim", _R(V.cosine(q, V.doubles("embedding"))))
    return best.orderBy(F.col("sim").desc(), "node_key", "ingest_seq").limit(20).select("branch_id", "node_key", "sim")


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP1: the channels of a search in one table: branches by vector, conversations by keyword, log entries by word."""
    geo = branches._ranked("balanced")(spark, sf_dir).orderBy(F.col("total").desc(), "branch_id").limit(5)
    kw = messages.keyword_score(spark, sf_dir).orderBy(F.col("score").desc(), F.col("phrase_messages").desc(), F.col("covered").desc(), "conversation_id").limit(5)
    logs = messages.daily_log_keyword(spark, sf_dir).orderBy(F.col("created_ts").desc(), "node_key").limit(5)
    return (
        geo.select(F.lit("geometry").alias("channel"), F.col("branch_id").alias("target"), F.col("total").alias("score"))
        .unionByName(kw.select(F.lit("keyword").alias("channel"), F.concat(F.lit("conv_"), F.col("conversation_id").cast("string")).alias("target"), "score"))
        .unionByName(logs.select(F.lit("daily_log").alias("channel"), F.col("node_key").alias("target"), F.lit(0.0).alias("score")))
    )


QUERIES = {
    f.__name__: f
    for f in (
        backfill_status, backfill_sample, summary_nodes, conversation_geometry, table_totals, conversation_candidates, new_identifiers, update_mode_classify, content_lengths, branch_ages, daily_log_semantic, hybrid_search,
    )
}

_B, _ID = Q.k("branch_id"), Q.k("id")
_USABLE = "len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0"

ORACLE = {
    "backfill_status": f"""WITH b AS (SELECT {_B} AS b FROM branch_states WHERE node_count > 0), m AS (SELECT conversation_id, count(*) AS n FROM messages GROUP BY 1)
SELECT c.conversation_id, CASE WHEN b.b IS NOT NULL THEN 'skipped_resume' WHEN n IS NULL THEN 'skipped_empty' ELSE 'processed' END AS status, coalesce(n, 0) AS messages,
  CASE WHEN b.b IS NULL THEN least(coalesce(n, 0), 200) ELSE 0 END AS taken FROM conversations c LEFT JOIN b ON b.b = 'conv_' || CAST(c.conversation_id AS VARCHAR) LEFT JOIN m USING (conversation_id)""",
    "backfill_sample": """WITH o AS (SELECT conversation_id, ingest_seq, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages WHERE conversation_id IS NOT NULL WINDOW w AS (PARTITION BY conversation_id ORDER BY coalesce(created_at, 0), ingest_seq)),
p AS (SELECT DISTINCT conversation_id, CASE WHEN n <= 200 THEN j ELSE (j * n) // 200 END AS r, j FROM (SELECT DISTINCT conversation_id, n FROM o), range(200) AS g(j) WHERE j < n)
SELECT conversation_id, ingest_seq, j AS place FROM o JOIN p USING (conversation_id, r)""",
    "summary_nodes": f"""WITH {Q.NODES.replace('FROM memory_nodes WHERE len', "FROM memory_nodes WHERE node_type = 'message' AND len")},
s AS (SELECT ingest_seq, node_type, {_B} AS branch_id, CAST(embedding AS DOUBLE[]) AS x FROM memory_nodes WHERE node_type IN ('leaf_summary', 'condensed_summary') AND {_USABLE}),
l AS (SELECT ingest_seq, node_type, branch_id, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM s)
SELECT ingest_seq, any_value(node_type) AS node_type, round(sqrt(sum((0.7 * v + 0.3 * m) * (0.7 * v + 0.3 * m))), 6) AS norm, round(sum(0.7 * v + 0.3 * m), 6) AS total FROM l JOIN mu USING (branch_id, i) GROUP BY 1""",
    "conversation_geometry": f"""WITH o AS (SELECT conversation_id AS c, {Q.k('message_id')} AS k, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages WHERE conversation_id IS NOT NULL WINDOW w AS (PARTITION BY conversation_id ORDER BY coalesce(created_at, 0), ingest_seq)),
total AS (SELECT DISTINCT c, n AS messages FROM o), p AS (SELECT DISTINCT c, (j * n) // 200 AS r FROM (SELECT DISTINCT c, n FROM o WHERE n > 200), range(200) AS g(j)),
keys AS (SELECT DISTINCT o.c, k FROM o LEFT JOIN p ON p.c = o.c AND p.r = o.r WHERE (n <= 200 OR p.r IS NOT NULL) AND k IS NOT NULL),
fn AS (SELECT {Q.k('lcm_id')} AS k, embedding, ingest_seq FROM memory_nodes WHERE node_type IN ('message', 'tool_result') AND {_USABLE} QUALIFY row_number() OVER (PARTITION BY {Q.k('lcm_id')} ORDER BY ingest_seq) = 1),
cn AS (SELECT CAST(c AS VARCHAR) AS branch_id, row_number() OVER (ORDER BY c, k) AS ingest_seq, NULL AS role, 1.0 AS importance_score, embedding FROM keys JOIN fn USING (k)),
{Q.NODES.replace('FROM memory_nodes WHERE len', 'FROM cn WHERE len')}
SELECT c AS conversation_id, messages, n, 'ACTIVE' AS state, 'conversation' AS branch_type, round(eff_rank, 6) AS eff_rank, round(trace, 6) AS trace, round(coherence, 6) AS coherence FROM geo JOIN total ON CAST(c AS VARCHAR) = branch_id""",
    "table_totals": """SELECT 'memory_nodes' AS name, count(*) AS rows, CAST(max(ingest_seq) AS BIGINT) AS last_seq FROM memory_nodes UNION ALL SELECT 'memory_edges', count(*), max(edge_seq) FROM memory_edges UNION ALL SELECT 'messages', count(*), max(ingest_seq) FROM messages
UNION ALL SELECT 'branch_states', count(*), 0 FROM branch_states UNION ALL SELECT 'summaries', count(*), 0 FROM summaries UNION ALL SELECT 'daily_log_content', count(*), 0 FROM daily_log_content""",
    "conversation_candidates": f"""SELECT {_B} AS branch_id, state, node_count FROM branch_states WHERE ({_B} LIKE 'conv\\_%' ESCAPE '\\' OR {_B} LIKE 'day\\_%' ESCAPE '\\') AND state IN ('FORMING', 'ACTIVE', 'REACTIVATING')
AND last_update_ts > 0 AND last_update_ts >= {AS_OF} - 90 * 86400 ORDER BY node_count DESC, 1 LIMIT 100""",
    "new_identifiers": f"""SELECT conversation_id, count(*) AS new_messages FROM (SELECT DISTINCT {Q.k('message_id')} AS k, conversation_id FROM messages) m
ANTI JOIN (SELECT {Q.k('lcm_id')} AS k FROM memory_nodes WHERE node_type IN ('message', 'tool_result')) n USING (k) WHERE k IS NOT NULL AND conversation_id IS NOT NULL GROUP BY 1""",
    "update_mode_classify": f"""WITH {Q.NODES}, ty AS (SELECT {_B} AS branch_id, lower(trim(branch_type)) AS ty FROM branch_states),
s AS (SELECT c.branch_id, round(c.c, 6) AS sim, coalesce(m.conflict_score, 0) AS f, m.node_type IN ('message', 'tool_result') AS forced, m.update_mode = 'fork' AS forked FROM cosn c JOIN memory_nodes m USING (ingest_seq))
SELECT CASE WHEN forked THEN 'fork' WHEN ty IN ('identity', 'user_fact', 'user_preference', 'preference') AND f >= 0.70 AND sim >= 0.78 THEN 'supersede' WHEN f >= 0.25 THEN 'contradict'
  WHEN sim >= 0.92 OR (forced AND f <= 0 AND sim >= 0.5) THEN 'refine' ELSE 'attach' END AS mode, coalesce(ty, 'none') AS branch_type, count(*) AS nodes, round(avg(sim), 6) AS avg_sim FROM s LEFT JOIN ty USING (branch_id) GROUP BY 1, 2""",
    "content_lengths": """SELECT CASE WHEN n = 0 THEN 'empty' WHEN n < 30 THEN 'short' WHEN n < 300 THEN 'middle' ELSE 'long' END AS size, count(*) AS messages, CAST(sum(n) AS BIGINT) AS signs FROM (SELECT length(regexp_replace(coalesce(content, ''), '^ +| +$', '', 'g')) AS n FROM messages) GROUP BY 1""",
    "branch_ages": f"""WITH a AS (SELECT {_B} AS branch_id, last_update_ts AS t, CAST(floor(({AS_OF} - last_update_ts) / 86400) AS BIGINT) AS d FROM branch_states)
SELECT branch_id, CASE WHEN t IS NULL THEN 'unknown' WHEN d < 1 THEN 'today' WHEN d < 2 THEN '1 day ago' ELSE CAST(d AS VARCHAR) || ' days ago' END AS age, CASE WHEN t IS NULL OR t <= 0 THEN 'unknown' WHEN t >= {AS_OF} - 1209600 THEN 'recent' ELSE 'stale' END AS activity FROM a""",
    "daily_log_semantic": f"""WITH {Q.NODES}, {Q.QUERY}, d AS (SELECT n.branch_id, n.ingest_seq, {Q.k('m.id')} AS node_key, n.x FROM nodes n JOIN memory_nodes m USING (ingest_seq)),
s AS (SELECT d.*, list_inner_product(x, (SELECT list(qv ORDER BY i) FROM q)) / ((sqrt(list_inner_product(x, x)) + 1e-9) * ((SELECT sqrt(sum(qv * qv)) FROM q) + 1e-9)) AS c FROM d JOIN (SELECT {Q.k('node_id')} AS node_key FROM daily_log_content) USING (node_key))
SELECT branch_id, node_key, round(c, 6) AS sim FROM s ORDER BY round(s.c, 6) DESC, node_key, ingest_seq LIMIT 20""",
}
ORACLE["hybrid_search"] = f"""SELECT 'geometry' AS channel, branch_id AS target, total AS score FROM (SELECT * FROM ({branches.ORACLE['branch_rank_balanced']}) ORDER BY total DESC, branch_id LIMIT 5)
UNION ALL SELECT 'keyword', 'conv_' || CAST(conversation_id AS VARCHAR), score FROM (SELECT * FROM ({messages.ORACLE['keyword_score']}) ORDER BY score DESC, phrase_messages DESC, covered DESC, conversation_id LIMIT 5)
UNION ALL SELECT 'daily_log', node_key, 0.0 FROM (SELECT * FROM ({messages.ORACLE['daily_log_keyword']}) ORDER BY created_ts DESC, node_key LIMIT 5)"""
