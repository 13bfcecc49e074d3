"""Queries on messages, lineage, feedback and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.config import AS_OF
from thicket.functions.keys import key
from thicket.operators import feedback, integrity, keyword, lineage, retrieval
from thicket.plans import sqlkit as Q
from thicket.plans.branches import nodes, states
from thicket.session import table

SEARCH = "retrieval step session archive"
TERMS, PHRASE = keyword.query_terms(SEARCH)
_R = lambda c: F.round(c, 6)


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").where("conversation_id IS NOT NULL")


def _n_conversations(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "conversations").count()


def keyword_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG14, STR1: conversations with each term, and the weight this gives the term."""
    w = keyword.document_weights(_messages(spark, sf_dir), TERMS, _n_conversations(spark, sf_dir))
    return w.select("term", "df", _R("idf").alias("idf"))


def _newest_matches(spark: SparkSession, sf_dir: str, most: int | None) -> DataFrame:
    m = keyword.matches(_messages(spark, sf_dir), TERMS, PHRASE)
    each = m.select("conversation_id", "message_id", "ingest_seq", "created_at", "content", "in_phrase", F.inline("hits"))
    top = each if most is None else retrieval.top_per_group(each, ["term"], [F.col("created_at").desc_nulls_last(), F.col("ingest_seq")], most)
    return top.select("term", "ingest_seq", "conversation_id", "pos", "in_phrase", keyword.snippet(F.col("content"), F.col("pos")).alias("snippet"))


def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP6, STR3: the newest matches of every term, max(2000, 300 for each wanted conversation), with a text window around the first hit."""
    return _newest_matches(spark, sf_dir, max(2000, 300 * 10))


def keyword_matches_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP6, STR3: all matches of every term, with a text window around the first hit."""
    return _newest_matches(spark, sf_dir, None)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    weights = keyword.document_weights(m, TERMS, _n_conversations(spark, sf_dir))
    return keyword.score(keyword.evidence(keyword.matches(m, TERMS, PHRASE), TERMS), TERMS, weights, PHRASE)


def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO17-18, TOP7: conversations by keyword score and its parts, the best 100."""
    s = _scored(spark, sf_dir).withColumn("score", _R("score"))
    s = s.orderBy(F.col("score").desc(), F.col("phrase_messages").desc(), F.col("covered").desc(), "conversation_id").limit(100)
    return s.select("conversation_id", "messages", "phrase_messages", F.col("covered").cast("long").alias("covered"), _R("part_terms").alias("part_terms"), _R("part_near").alias("part_near"), "score")


def daily_log_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN1-6: log entries with a term of the query, joined to their node and branch, the newest 50."""
    logs = table(spark, sf_dir, "daily_log_content").select(key("node_id").alias("node_key"), "text", "source", "created_ts")
    hit = logs.where(F.exists(F.array(*[F.lit(t) for t in TERMS]), lambda t: F.contains(F.lower("text"), t)))
    n = nodes(spark, sf_dir).select("branch_id", key("id").alias("node_key")).distinct()
    out = n.join(hit, "node_key").orderBy(F.col("created_ts").desc(), "node_key").limit(50)
    return out.select("branch_id", "node_key", "source", "created_ts", "text")


def daily_log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN2-3, JOIN5, WIN16: entries of every branch, first and last time, and the newest one."""
    logs = table(spark, sf_dir, "daily_log_content").select(key("node_id").alias("node_key"), "created_ts")
    n = nodes(spark, sf_dir).select("branch_id", key("id").alias("node_key")).distinct()
    newest = F.max(F.struct("created_ts", "node_key"))
    per = n.join(logs, "node_key").groupBy("branch_id").agg(F.count(F.lit(1)).alias("entries"), F.min("created_ts").alias("first_ts"), newest.alias("m"))
    return per.select("branch_id", "entries", "first_ts", F.col("m.created_ts").alias("last_ts"), F.col("m.node_key").alias("last_node"))


def source_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22-23, JOIN17: first and last source time of every branch with where it comes from.

    Messages and log entries first, then the branch's own last update.
    """
    n = nodes(spark, sf_dir).select("branch_id", key("lcm_id").alias("mk"), key("id").alias("nk"), "node_type").where("branch_id IS NOT NULL").distinct()
    msgs = table(spark, sf_dir, "messages").select(key("message_id").alias("mk"), F.col("created_at").alias("ts")).groupBy("mk").agg(F.min("ts").alias("ts"))
    logs = table(spark, sf_dir, "daily_log_content").select(key("node_id").alias("nk"), F.col("created_ts").alias("ts"))
    a = n.where("node_type IN ('message', 'tool_result')").select("branch_id", "mk").join(msgs, "mk").select("branch_id", "ts", F.lit("messages").alias("src"))
    b = n.select("branch_id", "nk").join(logs, "nk").select("branch_id", "ts", F.lit("daily_log").alias("src"))
    per = a.unionByName(b).where("ts IS NOT NULL").groupBy("branch_id").agg(F.min(F.struct("ts", "src")).alias("f"), F.max(F.struct("ts", "src")).alias("l"))
    out = states(spark, sf_dir).select("branch_id", "last_update_ts").join(per, "branch_id", "left")
    return out.select("branch_id", F.coalesce("f.ts", "last_update_ts").alias("first_ts"), F.coalesce("l.ts", "last_update_ts").alias("last_ts"),
                      F.when(F.col("f").isNotNull(), F.col("f.src")).when(F.col("last_update_ts").isNotNull(), "geometry").otherwise("none").alias("first_source"))


def hybrid_recommendation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SCO19, PIP1: which channel to use, from the number of keyword rows and the best similarity."""
    from thicket.plans import branches

    best = branches._ranked("balanced")(spark, sf_dir).agg(F.round(F.max("sem"), 4).alias("sem"))
    rows = keyword.matches(_messages(spark, sf_dir), TERMS, PHRASE).agg(F.count(F.lit(1)).alias("keyword_rows"))
    sem = F.coalesce("sem", F.lit(0.0))
    advice = F.when((F.col("keyword_rows") == 0) & (sem > 0.30), "geometry").when(sem < 0.25, "keyword").when((F.col("keyword_rows") > 0) & (sem > 0.30), "both").otherwise("geometry")
    return rows.join(F.broadcast(best)).select("keyword_rows", sem.alias("best_sem"), advice.alias("recommendation"))


def conversation_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP3, SRC7: the messages of every conversation in order, at most 100 (its limit of entries), with their whole text."""
    m = _messages(spark, sf_dir).where("seq IS NOT NULL")
    top = retrieval.top_per_group(m, ["conversation_id"], [F.col("seq"), F.col("ingest_seq")], 100)
    return top.select("conversation_id", "seq", "ingest_seq", "role", "content")


def branch_lineage_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8-10: messages and summaries behind the nodes of every branch, counted by their conversation."""
    n = nodes(spark, sf_dir).select("branch_id", key("lcm_id").alias("k"), "node_type").where("branch_id IS NOT NULL").distinct()
    msgs = table(spark, sf_dir, "messages").select(key("message_id").alias("k"), "conversation_id").distinct()
    sums = table(spark, sf_dir, "summaries").select(key("summary_id").alias("k"), "conversation_id").distinct()
    a = n.where("node_type IN ('message', 'tool_result')").join(msgs, "k")
    b = n.where("node_type IN ('leaf_summary', 'condensed_summary')").join(sums, "k")
    return a.unionByName(b).groupBy("branch_id", "conversation_id").agg(F.count(F.lit(1)).alias("records"), F.sum((F.col("node_type").contains("summary")).cast("long")).alias("summaries"))


def temporal_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN2, GRF1: each node of a branch linked to the next."""
    return lineage.temporal_edges(nodes(spark, sf_dir))


def correction_chain_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3-4: chains of corrections rebuilt from the update modes."""
    return lineage.correction_chains(nodes(spark, sf_dir))


def latest_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN6: length and latest version of every chain."""
    n = table(spark, sf_dir, "memory_nodes").select(key("id").alias("id"), key("correction_root_id").alias("correction_root_id"), "correction_version", "timestamp", "ingest_seq")
    return lineage.latest_versions(n)


def recent_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN7: the last eight linked nodes of every branch."""
    n = nodes(spark, sf_dir).where("correction_prev_id IS NOT NULL AND branch_id IS NOT NULL").select("branch_id", "id", "ingest_seq", "timestamp", "correction_version")
    return retrieval.top_per_group(n, ["branch_id"], [F.col("timestamp").desc(), F.col("ingest_seq").desc()], 8)


def duplicate_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1: message nodes delivered again, and the node that stays."""
    n = nodes(spark, sf_dir).where("node_type = 'message' AND branch_id IS NOT NULL").select("branch_id", key("lcm_id").alias("lcm_id"), "ingest_seq", key("id").alias("id"))
    return lineage.duplicate_map(n.where("lcm_id IS NOT NULL"))


def dedupe_rewire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK23: links of the remaining nodes led from removed copies to the ones that stay."""
    return integrity.rewire(nodes(spark, sf_dir), duplicate_map(spark, sf_dir))


def duplicate_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11, AGG21: rows, distinct identifiers and repeats per node type."""
    n = nodes(spark, sf_dir).select("node_type", F.xxhash64(key("lcm_id"), "branch_id").alias("h"))
    per = n.groupBy("node_type", "h").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("node_type").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("distinct_ids"), F.sum((F.col("c") > 1).cast("long")).alias("repeated_ids"))


def orphan_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN9, JOIN11-12: edges per type with an end that is no node."""
    return integrity.orphan_edges(table(spark, sf_dir, "memory_edges"), nodes(spark, sf_dir))


def topology_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN8: conversations without branch, branches without conversation, nodes of unknown branches."""
    return integrity.topology(table(spark, sf_dir, "conversations"), states(spark, sf_dir), nodes(spark, sf_dir))


def relabelled_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN10, JOIN13, SNK22: contradicting edges that no correction backs become topic drift."""
    return integrity.relabel(table(spark, sf_dir, "memory_edges"), nodes(spark, sf_dir))


def last_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5-6: one edge per (source, target, type), the one written last."""
    return integrity.last_write(table(spark, sf_dir, "memory_edges"))


def cross_agent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT18, GRF5: links shared across agents, the heaviest 200."""
    e = integrity.last_write(table(spark, sf_dir, "memory_edges")).where("edge_type = 'cross_agent_shared'")
    return e.orderBy(F.col("weight").desc(), "src", "dst").limit(200).select("src", "dst", "weight")


def dag_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: summaries linked to the message nodes of their conversation, one edge per latest node."""
    return integrity.dag_edges(table(spark, sf_dir, "summaries"), table(spark, sf_dir, "messages"), nodes(spark, sf_dir))


def _feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as feedback on branches: four events are a query."""
    e = table(spark, sf_dir, "events")
    t = F.col("event_type")
    return e.select(
        F.col("event_id").alias("seq"), F.expr("event_id div 4").alias("query_id"), F.concat(F.lit("conv_"), (F.col("user_id") % 10).cast("string")).alias("branch_id"),
        t.isin("click", "purchase").alias("used"), (t == "error").alias("corrected"), (t == "view").alias("expanded"),
        F.when(t == "signup", F.least(F.lit(1.0), F.col("value") / 500)).alias("usefulness_signal"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("us"),
    ).withColumn("timestamp", F.col("us") / 1e6).drop("us")


def feedback_usefulness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: exponential means of usefulness and error after all feedback."""
    out = feedback.usefulness(_feedback(spark, sf_dir))
    return out.select("branch_id", "n", _R("usefulness").alias("usefulness"), _R("retrieval_error").alias("retrieval_error"))


def feedback_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG6."""
    out = feedback.statistics(_feedback(spark, sf_dir))
    return out.select("branch_id", "n", *[_R(c).alias(c) for c in ("use_rate", "correction_rate", "expansion_rate")])


def retrieval_co_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG7."""
    out = feedback.co_use(_feedback(spark, sf_dir))
    return out.select("branch_a", "branch_b", "shared", "queries", _R("co_use").alias("co_use"))


def feedback_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK17-18: feedback that stays after the age and size limits of Config, per branch."""
    kept = feedback.retained(_feedback(spark, sf_dir), 1706659200.0)
    return kept.groupBy("branch_id").agg(F.count(F.lit(1)).alias("kept"), F.min("seq").alias("first_seq"))


def branch_last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG5: the later of the last node and the last feedback."""
    a = nodes(spark, sf_dir).where("branch_id IS NOT NULL").groupBy("branch_id").agg(F.max("timestamp").alias("t"))
    b = _feedback(spark, sf_dir).groupBy("branch_id").agg(F.max("timestamp").alias("f"))
    return a.join(b, "branch_id", "full").select("branch_id", F.greatest(F.coalesce("t", F.lit(0.0)), F.coalesce("f", F.lit(0.0))).alias("last_ts"))


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes(spark, sf_dir).where("node_type = 'tool_result'").select(key("id").alias("k")).where("k IS NOT NULL").distinct()


def _per_type(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.max("edge_seq").alias("last_seq"))


def edges_within_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK14: edges between nodes that hold tool results, per type."""
    return _per_type(integrity.edges_within(table(spark, sf_dir, "memory_edges"), _picked(spark, sf_dir)))


def edges_apart_from_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK15: edges left per type when all that touch nodes with tool results go."""
    return _per_type(integrity.edges_apart(table(spark, sf_dir, "memory_edges"), _picked(spark, sf_dir)))


def edges_without_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK16: edges left per type when refining edges with a missing end go."""
    return _per_type(integrity.without_orphans(table(spark, sf_dir, "memory_edges"), nodes(spark, sf_dir), ["refines"]))


def reassigned_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13: nodes per branch after those of one branch with odd numbers moved to a child."""
    n = nodes(spark, sf_dir)
    moved = n.where("branch_id = 'conv_1' AND ingest_seq % 2 = 1").select("ingest_seq", F.lit("conv_1_b").alias("new_branch"))
    return integrity.reassign(n.select("ingest_seq", "branch_id"), moved).groupBy("branch_id").agg(F.count(F.lit(1)).alias("nodes"))


QUERIES = {
    f.__name__: f
    for f in (
        keyword_idf, keyword_matches, keyword_matches_whole, keyword_score, daily_log_keyword, daily_log_latest, source_times, hybrid_recommendation, conversation_content, branch_lineage_content,
        temporal_edges, correction_chain_islands, latest_correction, recent_corrections, duplicate_map, dedupe_rewire, duplicate_stats, orphan_edge_counts, topology_check,
        relabelled_edges, last_edges, cross_agent_edges, dag_edges, feedback_usefulness, feedback_stats, retrieval_co_use, feedback_retention, branch_last_activity,
        edges_within_set, edges_apart_from_set, edges_without_orphans, reassigned_nodes,
    )
}

_B, _ID = Q.k("branch_id"), Q.k("id")
_T = "(VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(TERMS)) + ") AS terms(ti, term)"
_N = len(TERMS)
_HITS = f"""hit AS (SELECT conversation_id, message_id, ingest_seq, created_at, content, ti, term, instr(lower(content), term) AS pos, contains(lower(content), '{PHRASE}') AS in_phrase
  FROM messages, {_T} WHERE conversation_id IS NOT NULL AND contains(lower(content), term)),
df AS (SELECT term, ti, count(DISTINCT conversation_id) AS df FROM hit GROUP BY 1, 2),
w AS (SELECT *, least(2.25, greatest(0.65, 1 + ln((1 + (SELECT greatest(count(*), 1) FROM conversations)) / (1 + greatest(df, 1))))) AS idf FROM df)"""
_FB = Q.FEEDBACK
_ORD = f"""o AS (SELECT {_B} AS b, id, ingest_seq, update_mode, lag(id) OVER w AS prev, row_number() OVER w AS rn FROM memory_nodes WHERE {_B} IS NOT NULL
  WINDOW w AS (PARTITION BY {_B} ORDER BY coalesce("timestamp", 0), ingest_seq))"""
_DUP = f"""d AS (SELECT ingest_seq, {_ID} AS id, first_value({_ID}) OVER w AS keep_id, row_number() OVER w AS rn FROM memory_nodes WHERE node_type = 'message' AND {_B} IS NOT NULL AND {Q.k('lcm_id')} IS NOT NULL
  WINDOW w AS (PARTITION BY {_B}, {Q.k('lcm_id')} ORDER BY ingest_seq)),
dup AS (SELECT ingest_seq, id, keep_id FROM d WHERE rn > 1)"""
_IDS = f"ids AS (SELECT DISTINCT {_ID} AS k FROM memory_nodes)"

ORACLE = {
    "keyword_idf": f"WITH {_HITS} SELECT term, df, round(idf, 6) AS idf FROM w",
    "keyword_matches": rf"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY created_at DESC NULLS LAST, ingest_seq) AS rn FROM hit)
SELECT term, ingest_seq, conversation_id, pos, in_phrase, trim(regexp_replace(substr(content, greatest(pos - 100, 1), 260), '\s+', ' ', 'g')) AS snippet FROM r WHERE rn <= 3000""",
    "keyword_score": f"""WITH {_HITS}, m AS (SELECT conversation_id, ingest_seq, any_value(created_at) AS created_at, any_value(in_phrase) AS p, count(*) AS c, max(pos) - min(pos) AS span FROM hit GROUP BY 1, 2),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY p DESC, (c = {_N}) DESC, c DESC, span, coalesce(created_at, 0) DESC, ingest_seq) = 1),
per AS (SELECT conversation_id, count(*) AS messages, count(*) FILTER (p) AS phrase_messages FROM m GROUP BY 1),
cov AS (SELECT conversation_id, count(*) AS covered, sum(idf) AS si FROM (SELECT DISTINCT conversation_id, term FROM hit) JOIN w USING (term) GROUP BY 1),
s AS (SELECT conversation_id, messages, phrase_messages, covered, 2 * si AS part_terms,
  2.5 * CASE WHEN c <= 1 THEN 0 WHEN span <= 120 THEN 1 WHEN span <= 300 THEN 0.8 WHEN span <= 800 THEN 0.45 WHEN span <= 1600 THEN 0.2 ELSE 0 END AS part_near,
  CASE WHEN covered = {_N} THEN 2 ELSE 0 END + CASE WHEN phrase_messages > 0 THEN 3 + ln(1 + phrase_messages) ELSE 0 END + 3 * c / {_N} + CASE WHEN c = {_N} THEN 2 ELSE 0 END
  + 0.75 * ln(1 + least(messages, 40)) - 2.5 * (1 - c / {_N}) - least(2.0, ln(1 + messages / 200.0)) AS rest FROM per JOIN best USING (conversation_id) JOIN cov USING (conversation_id))
SELECT conversation_id, messages, phrase_messages, covered, round(part_terms, 6) AS part_terms, round(part_near, 6) AS part_near, round(part_terms + part_near + rest, 6) AS score FROM s
ORDER BY round(s.part_terms + s.part_near + rest, 6) DESC, phrase_messages DESC, covered DESC, conversation_id LIMIT 100""",
    "daily_log_keyword": f"""SELECT branch_id, node_key, source, created_ts, text FROM (SELECT DISTINCT {_B} AS branch_id, {_ID} AS node_key FROM memory_nodes)
JOIN (SELECT {Q.k('node_id')} AS node_key, text, source, created_ts FROM daily_log_content WHERE {' OR '.join(f"contains(lower(text), '{t}')" for t in TERMS)}) USING (node_key) ORDER BY created_ts DESC, node_key LIMIT 50""",
    "daily_log_latest": f"""SELECT branch_id, count(*) AS entries, min(created_ts) AS first_ts, max(created_ts) AS last_ts, arg_max(node_key, (created_ts, node_key)) AS last_node
FROM (SELECT DISTINCT {_B} AS branch_id, {_ID} AS node_key FROM memory_nodes) JOIN (SELECT {Q.k('node_id')} AS node_key, created_ts FROM daily_log_content) USING (node_key) GROUP BY 1""",
    "source_times": f"""WITH n AS (SELECT DISTINCT {_B} AS b, {Q.k('lcm_id')} AS mk, {_ID} AS nk, node_type FROM memory_nodes), t AS (
  SELECT b, ts, 'messages' AS src FROM n JOIN (SELECT {Q.k('message_id')} AS mk, min(created_at) AS ts FROM messages GROUP BY 1) USING (mk) WHERE node_type IN ('message', 'tool_result') AND ts IS NOT NULL
  UNION ALL SELECT b, created_ts, 'daily_log' FROM n JOIN (SELECT {Q.k('node_id')} AS nk, created_ts FROM daily_log_content) USING (nk) WHERE created_ts IS NOT NULL),
per AS (SELECT b, min(ts) AS f, max(ts) AS l, arg_min(src, (ts, src)) AS s FROM t GROUP BY 1)
SELECT x.b AS branch_id, coalesce(f, u) AS first_ts, coalesce(l, u) AS last_ts, CASE WHEN s IS NOT NULL THEN s WHEN u IS NOT NULL THEN 'geometry' ELSE 'none' END AS first_source
FROM (SELECT {_B} AS b, last_update_ts AS u FROM branch_states) x LEFT JOIN per ON x.b = per.b""",
    "hybrid_recommendation": f"""WITH {Q.scored('balanced')}, top AS (SELECT sem FROM tot WHERE state NOT IN ('COLLAPSING', 'SPLIT_PENDING') ORDER BY tot.total DESC, branch_id LIMIT 128),
b AS (SELECT coalesce(round(max(round(sem, 6)), 4), 0) AS s FROM top),
m AS (SELECT count(*) AS n FROM messages WHERE conversation_id IS NOT NULL AND ({' OR '.join(f"contains(lower(content), '{t}')" for t in TERMS)}))
SELECT n AS keyword_rows, s AS best_sem, CASE WHEN n = 0 AND s > 0.30 THEN 'geometry' WHEN s < 0.25 THEN 'keyword' WHEN n > 0 AND s > 0.30 THEN 'both' ELSE 'geometry' END AS recommendation FROM m, b""",
    "conversation_content": """SELECT conversation_id, seq, ingest_seq, role, content FROM messages WHERE conversation_id IS NOT NULL AND seq IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY seq, ingest_seq) <= 100""",
    "branch_lineage_content": f"""WITH n AS (SELECT DISTINCT {_B} AS b, {Q.k('lcm_id')} AS k, node_type AS t FROM memory_nodes WHERE {_B} IS NOT NULL),
r AS (SELECT b, t, conversation_id FROM n JOIN (SELECT DISTINCT {Q.k('message_id')} AS k, conversation_id FROM messages) USING (k) WHERE t IN ('message', 'tool_result')
  UNION ALL SELECT b, t, conversation_id FROM n JOIN (SELECT DISTINCT {Q.k('summary_id')} AS k, conversation_id FROM summaries) USING (k) WHERE t IN ('leaf_summary', 'condensed_summary'))
SELECT b AS branch_id, conversation_id, count(*) AS records, count(*) FILTER (t LIKE '%summary%') AS summaries FROM r GROUP BY 1, 2""",
    "temporal_edges": f"WITH {_ORD} SELECT prev AS src_id, id AS dst_id FROM o WHERE prev IS NOT NULL",
    "correction_chain_islands": f"""WITH {_ORD}, s AS (SELECT *, (prev IS NULL OR NOT coalesce(update_mode IN ('refine', 'contradict', 'supersede'), false)) AS st FROM o),
c AS (SELECT *, sum(CASE WHEN st THEN 1 ELSE 0 END) OVER (PARTITION BY b ORDER BY rn) AS ch FROM s),
v AS (SELECT *, row_number() OVER (PARTITION BY b, ch ORDER BY rn) AS ver, first_value(id) OVER (PARTITION BY b, ch ORDER BY rn) AS root FROM c)
SELECT id, ingest_seq, CASE WHEN ver > 1 THEN update_mode ELSE 'none' END AS kind, CASE WHEN ver > 1 THEN prev END AS prev_id, CASE WHEN ver > 1 THEN root END AS root_id, ver AS version FROM v""",
    "latest_correction": f"""WITH n AS (SELECT {_ID} AS id, coalesce({Q.k('correction_root_id')}, {_ID}) AS root_id, correction_version AS v, "timestamp" AS t, ingest_seq AS s FROM memory_nodes)
SELECT root_id, count(*) AS length, arg_max(id, (v, t, s)) AS latest_id, max(v) AS version FROM n GROUP BY 1 HAVING count(*) > 1""",
    "recent_corrections": f"""SELECT {_B} AS branch_id, id, ingest_seq, "timestamp", correction_version FROM memory_nodes WHERE correction_prev_id IS NOT NULL AND {_B} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {_B} ORDER BY "timestamp" DESC, ingest_seq DESC) <= 8""",
    "duplicate_map": f"WITH {_DUP} SELECT * FROM dup",
    "dedupe_rewire": f"""WITH {_DUP}, map AS (SELECT id, min(keep_id) AS k FROM dup WHERE id <> keep_id GROUP BY 1),
n AS (SELECT ingest_seq, {_ID} AS id, {Q.k('parent_id')} AS p, {Q.k('correction_prev_id')} AS c, {Q.k('correction_root_id')} AS r FROM memory_nodes WHERE ingest_seq NOT IN (SELECT ingest_seq FROM dup))
SELECT n.ingest_seq, n.id, coalesce(a.k, p) AS parent_id, coalesce(b.k, c) AS correction_prev_id, coalesce(d.k, r) AS correction_root_id FROM n LEFT JOIN map a ON a.id = p LEFT JOIN map b ON b.id = c LEFT JOIN map d ON d.id = r
WHERE a.k IS NOT NULL OR b.k IS NOT NULL OR d.k IS NOT NULL""",
    "duplicate_stats": f"""SELECT node_type, CAST(sum(c) AS BIGINT) AS rows, count(*) AS distinct_ids, count(*) FILTER (c > 1) AS repeated_ids FROM (SELECT node_type, {Q.k('lcm_id')} AS l, {_B} AS b, count(*) AS c FROM memory_nodes GROUP BY 1, 2, 3) GROUP BY 1""",
    "orphan_edge_counts": f"""WITH {_IDS} SELECT edge_type, count(*) AS edges, count(*) FILTER (s.k IS NULL) AS no_source, count(*) FILTER (d.k IS NULL) AS no_target, count(*) FILTER (s.k IS NULL OR d.k IS NULL) AS orphans
FROM memory_edges LEFT JOIN ids s ON s.k = {Q.k('src_id')} LEFT JOIN ids d ON d.k = {Q.k('dst_id')} GROUP BY 1""",
    "topology_check": f"""WITH b AS (SELECT {_B} AS b FROM branch_states), c AS (SELECT 'conv_' || CAST(conversation_id AS VARCHAR) AS b FROM conversations), n AS (SELECT {_B} AS b FROM memory_nodes)
SELECT 'conversation_without_branch' AS problem, (SELECT count(*) FROM c ANTI JOIN b USING (b)) AS rows
UNION ALL SELECT 'branch_without_conversation', (SELECT count(*) FROM b ANTI JOIN c USING (b) WHERE b.b LIKE 'conv_%')
UNION ALL SELECT 'node_without_branch', (SELECT count(*) FROM n ANTI JOIN b USING (b))""",
    "relabelled_edges": f"""WITH n AS (SELECT DISTINCT {_ID} AS k, {Q.k('correction_prev_id')} AS p, {Q.k('parent_id')} AS u FROM memory_nodes),
e AS (SELECT edge_seq, {Q.k('src_id')} AS s, {Q.k('dst_id')} AS d FROM memory_edges WHERE edge_type = 'contradicts')
SELECT edge_seq, CASE WHEN EXISTS (SELECT 1 FROM n WHERE n.k = e.s AND n.p = e.d) OR EXISTS (SELECT 1 FROM n WHERE n.k = e.d AND n.u = e.s) THEN 'contradicts' ELSE 'topic_drift' END AS edge_type FROM e""",
    "last_edges": f"""SELECT {Q.k('src_id')} AS src, {Q.k('dst_id')} AS dst, edge_type, arg_max(weight, edge_seq) AS weight, max(edge_seq) AS edge_seq FROM memory_edges GROUP BY 1, 2, 3""",
    "cross_agent_edges": f"""SELECT {Q.k('src_id')} AS src, {Q.k('dst_id')} AS dst, arg_max(weight, edge_seq) AS weight FROM memory_edges WHERE edge_type = 'cross_agent_shared' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 200""",
    "dag_edges": f"""WITH s AS (SELECT {Q.k('summary_id')} AS k, conversation_id FROM summaries WHERE depth = 0), m AS (SELECT DISTINCT {Q.k('message_id')} AS k, conversation_id FROM messages WHERE {Q.k('message_id')} IS NOT NULL),
l AS (SELECT {Q.k('lcm_id')} AS k, node_type IN ('leaf_summary', 'condensed_summary') AS su, arg_max({_ID}, ingest_seq) AS id FROM memory_nodes WHERE node_type IN ('leaf_summary', 'condensed_summary', 'message') GROUP BY 1, 2),
x AS (SELECT l.id AS src, conversation_id FROM s JOIN l ON s.k = l.k AND su), y AS (SELECT conversation_id, count(*) AS targets, min(l.id) AS least, max(l.id) AS greatest FROM m JOIN l ON m.k = l.k AND NOT su GROUP BY 1)
SELECT src, x.conversation_id, targets, least, greatest FROM x JOIN y USING (conversation_id)""",
    **{
        name: f"""WITH p AS (SELECT DISTINCT {_ID} AS k FROM memory_nodes WHERE {pick}), e AS (SELECT edge_type, edge_seq, {Q.k('src_id')} IN (SELECT k FROM p) AS s, {Q.k('dst_id')} IN (SELECT k FROM p) AS d FROM memory_edges)
SELECT edge_type, count(*) AS edges, max(edge_seq) AS last_seq FROM e WHERE {rule} GROUP BY 1"""
        for name, pick, rule in (
            ("edges_within_set", "node_type = 'tool_result'", "s AND d"), ("edges_apart_from_set", "node_type = 'tool_result'", "NOT s AND NOT d"),
            ("edges_without_orphans", "true", "edge_type <> 'refines' OR (s AND d)"),
        )
    },
    "reassigned_nodes": f"SELECT CASE WHEN {_B} = 'conv_1' AND ingest_seq % 2 = 1 THEN 'conv_1_b' ELSE {_B} END AS branch_id, count(*) AS nodes FROM memory_nodes GROUP BY 1",
    "feedback_usefulness": f"""WITH {_FB}, r AS (SELECT branch_id, CASE WHEN sig IS NOT NULL THEN greatest(0, least(1, sig)) WHEN corrected THEN -0.5 WHEN used THEN 1.0 ELSE 0 END AS r, CASE WHEN corrected THEN 1.0 ELSE 0 END AS c,
  row_number() OVER (PARTITION BY branch_id ORDER BY t DESC, seq DESC) - 1 AS j FROM fb)
SELECT branch_id, count(*) AS n, round(sum(0.1 * pow(0.9, j) * r), 6) AS usefulness, round(sum(0.1 * pow(0.9, j) * c), 6) AS retrieval_error FROM r GROUP BY 1""",
    "feedback_stats": f"""WITH {_FB} SELECT branch_id, count(*) AS n, round(avg(coalesce(sig, CASE WHEN used THEN 1.0 ELSE 0 END)), 6) AS use_rate, round(avg(CASE WHEN corrected THEN 1.0 ELSE 0 END), 6) AS correction_rate,
  round(avg(CASE WHEN expanded THEN 1.0 ELSE 0 END), 6) AS expansion_rate FROM fb GROUP BY 1""",
    "retrieval_co_use": f"SELECT branch_a, branch_b, shared, queries, round(co, 6) AS co_use FROM ({Q.CO_USE})",
    "feedback_retention": f"""WITH {_FB}, k AS (SELECT * FROM fb WHERE t >= 1706659200 - 90 * 86400 QUALIFY row_number() OVER (ORDER BY t DESC, seq DESC) <= 200000) SELECT branch_id, count(*) AS kept, min(seq) AS first_seq FROM k GROUP BY 1""",
    "branch_last_activity": f"""WITH {_FB}, a AS (SELECT {_B} AS branch_id, max("timestamp") AS t FROM memory_nodes WHERE {_B} IS NOT NULL GROUP BY 1), b AS (SELECT branch_id, max(t) AS f FROM fb GROUP BY 1)
SELECT branch_id, greatest(coalesce(a.t, 0), coalesce(f, 0)) AS last_ts FROM a FULL JOIN b USING (branch_id)""",
}
ORACLE["keyword_matches_whole"] = ORACLE["keyword_matches"].replace(" WHERE rn <= 3000", "")
