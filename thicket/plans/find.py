"""Queries on finding and showing: scans, snippets, ordered sets, text search, content, fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from thicket.config import AS_OF
from thicket.functions import embed, times
from thicket.functions.keys import key
from thicket.operators import backfill, keyword, retrieval
from thicket.plans import branches, messages
from thicket.plans import sqlkit as Q
from thicket.plans.branches import DIM, nodes, states
from thicket.session import table

_R = lambda c: F.round(c, 6)

#: Branches shown with their content, entries shown of all, and the least of each.
SHOWN, ENTRIES, LEAST = 20, 100, 3
WORKING = retrieval.STATE_GROUPS["working"]


def source_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: all messages and summaries with their place in their conversation and their whole text."""
    m = table(spark, sf_dir, "messages").select(F.lit("message").alias("kind"), "conversation_id", F.col("seq").alias("place"), F.col("message_id").alias("record_id"), F.col("content").alias("text"))
    s = table(spark, sf_dir, "summaries").select(F.lit("summary").alias("kind"), "conversation_id", F.col("depth").alias("place"), F.col("summary_id").alias("record_id"), F.col("content").alias("text"))
    every = m.unionByName(s)
    every = every.withColumn("conversation_id", F.coalesce("conversation_id", F.lit(-1)))  # stray records together
    return every.groupBy("kind", "conversation_id").agg(F.count(F.lit(1)).alias("records"), F.count("text").alias("texts"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("signs"), F.max("place").cast("string").alias("last_place"))


def backfill_ends_and_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN9, SRC2: messages of a selected backfill: the first, the last, and every step-th between, at most 200 of a conversation."""
    m = table(spark, sf_dir, "messages").where("conversation_id IS NOT NULL")
    return backfill.ends_and_stride(m, "conversation_id", 200).select("conversation_id", "ingest_seq")


def log_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR2: log texts on one line, cut to 240 signs with an ellipsis."""
    logs = table(spark, sf_dir, "daily_log_content")
    return logs.select(key("node_id").alias("node_key"), keyword.one_line(F.col("text"), 240).alias("snippet"))


def keyword_match_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET3: matches of a message delivered several times as one for each term, the last delivery."""
    m = keyword.matches(messages._messages(spark, sf_dir), messages.TERMS, messages.PHRASE)
    each = m.select(key("message_id").alias("message_key"), "ingest_seq", F.inline("hits"))
    return each.where("message_key IS NOT NULL").groupBy("message_key", "term").agg(F.max("ingest_seq").alias("last_seq"), F.count(F.lit(1)).alias("deliveries"))


def branch_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET5, SRC9: the distinct records behind every branch with the place where each came first."""
    n = nodes(spark, sf_dir).select("branch_id", key("lcm_id").alias("lcm_key"), "ingest_seq").where("branch_id IS NOT NULL AND lcm_key IS NOT NULL")
    return n.groupBy("branch_id", "lcm_key").agg(F.min("ingest_seq").alias("first_seq"))


def keyword_with_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN18: the best conversations by keyword with the rank their branch has by vector (0 beyond the 128 ranked)."""
    sem = branches._ranked("balanced")(spark, sf_dir)
    sem = sem.select("branch_id", F.row_number().over(Window.orderBy(F.col("total").desc(), "branch_id")).cast("long").alias("rank"), "total")  # 128 rows at most
    kw = messages.keyword_score(spark, sf_dir).select("conversation_id", "score", F.concat(F.lit("conv_"), F.col("conversation_id").cast("string")).alias("branch_id"))
    return kw.join(F.broadcast(sem), "branch_id", "left").select("conversation_id", "score", F.coalesce("rank", F.lit(0)).alias("sem_rank"), F.coalesce("total", F.lit(0.0)).alias("sem_total"))


def text_vector(text: str) -> list[float]:
    """The vector of a query text by the provider the nodes would be embedded with."""
    return [float(x) for x in embed.hashing_provider(DIM)([text])[0]]


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF4, PIP1: a search by text: its vector ranks branches, collapsing ones apart, its terms rank conversations and find
    log entries, and a last row says which channel to trust."""
    b = branches._located(spark, sf_dir)
    q = text_vector(messages.SEARCH)
    geo = retrieval.ranking(b, q).withColumn("total", _R("total")).orderBy(F.col("total").desc(), "branch_id").limit(5)
    side = retrieval.score(b.where("state = 'COLLAPSING' AND node_count > 0"), q).withColumn("total", _R("total")).orderBy(F.col("total").desc(), "branch_id").limit(5)
    kw = messages.keyword_score(spark, sf_dir).orderBy(F.col("score").desc(), F.col("phrase_messages").desc(), F.col("covered").desc(), "conversation_id").limit(5)
    logs = messages.daily_log_keyword(spark, sf_dir).orderBy(F.col("created_ts").desc(), "node_key").limit(5)
    sem = F.coalesce(F.round(F.max("sem"), 4), F.lit(0.0))
    found = keyword.matches(messages._messages(spark, sf_dir), messages.TERMS, messages.PHRASE).agg(F.count(F.lit(1)).alias("n"))
    advice = F.when((F.col("n") == 0) & (F.col("s") > 0.30), "geometry").when(F.col("s") < 0.25, "keyword").when((F.col("n") > 0) & (F.col("s") > 0.30), "both").otherwise("geometry")
    row = lambda df, name, target, score: df.select(F.lit(name).alias("channel"), target.alias("target"), score.cast("double").alias("score"))
    return (
        row(geo, "geometry", F.col("branch_id"), F.col("total")).unionByName(row(side, "collapsing", F.col("branch_id"), F.col("total")))
        .unionByName(row(kw, "keyword", F.concat(F.lit("conv_"), F.col("conversation_id").cast("string")), F.col("score")))
        .unionByName(row(logs, "daily_log", F.col("node_key"), F.lit(0.0)))
        .unionByName(row(geo.agg(sem.alias("s")).join(found), "recommendation", advice, F.col("s")))
    )


def content_fair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PIP3, TOP11, STR6: entries shown of the branches updated last: a fair number of each, cut in their order when all is full.

    Summaries first; a branch without them shows messages and says so.
    """
    b = states(spark, sf_dir).where("branch_id LIKE 'conv%'").orderBy(F.col("last_update_ts").desc_nulls_last(), "branch_id").limit(SHOWN).select("branch_id", "last_update_ts")
    place = Window.orderBy(F.col("last_update_ts").desc_nulls_last(), "branch_id")
    b = b.withColumn("place", F.row_number().over(place))
    n = nodes(spark, sf_dir).select("branch_id", key("lcm_id").alias("k"), "node_type").join(F.broadcast(b.select("branch_id")), "branch_id")
    msgs = table(spark, sf_dir, "messages").select(key("message_id").alias("k")).where("k IS NOT NULL").distinct()
    sums = table(spark, sf_dir, "summaries").select(key("summary_id").alias("k")).where("k IS NOT NULL").distinct()
    count = lambda kinds, records, name: n.where(F.col("node_type").isin(kinds)).select("branch_id", "k").distinct().join(records, "k").groupBy("branch_id").agg(F.count(F.lit(1)).alias(name))
    j = b.join(count(["leaf_summary", "condensed_summary"], sums, "s"), "branch_id", "left").join(count(["message", "tool_result"], msgs, "m"), "branch_id", "left").fillna(0, ["s", "m"])
    each = F.greatest(F.expr(f"{ENTRIES} div {SHOWN}"), F.lit(LEAST))
    j = j.withColumn("take", F.least(F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("m")), each))
    before = F.coalesce(F.sum("take").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    j = j.withColumn("entries", F.greatest(F.least(F.col("take"), F.lit(ENTRIES) - before), F.lit(0)))
    warnings = keyword.warnings(F.when((F.col("s") == 0) & (F.col("m") > 0), "summary_empty_used_messages_fallback"), F.when(F.col("entries") < F.col("take"), "trimmed"))
    return j.select(F.col("place").cast("long").alias("place"), "branch_id", F.col("entries").cast("long").alias("entries"), warnings.alias("warning"))


def conversation_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT12: active conversations of the last days; where there are none, those of the working states, with the reason."""
    b = states(spark, sf_dir).where(F.col("branch_id").startswith("conv_")).select("branch_id", "state", "last_update_ts")
    now = b.where((F.col("state") == "ACTIVE") & (times.activity(F.col("last_update_ts"), AS_OF, 0.02) == "recent"))
    none = F.broadcast(now.agg((F.count(F.lit(1)) == 0).alias("none")))
    rest = b.where(F.col("state").isin(*WORKING)).join(none).where("none").drop("none")
    return now.select("branch_id", "state", F.lit("none").alias("reason")).unionByName(rest.select("branch_id", "state", F.lit("active_recent_empty_used_working_group").alias("reason")))


def conversation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7, PIP3: the summaries of every conversation, the deepest first, at most 100 (its limit of entries), with their whole text."""
    s = table(spark, sf_dir, "summaries").where("conversation_id IS NOT NULL")
    top = retrieval.top_per_group(s, ["conversation_id"], [F.col("depth").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("summary_id")], ENTRIES)
    return top.select("conversation_id", "summary_id", "depth", "content")


def branch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, PIP3: the newest records behind every branch with their text, at most 100 of each."""
    n = nodes(spark, sf_dir).where("branch_id IS NOT NULL").select("branch_id", key("lcm_id").alias("k"), F.col("node_type").contains("summary").alias("su")).where("k IS NOT NULL").distinct()
    m = table(spark, sf_dir, "messages").groupBy(key("message_id").alias("k")).agg(F.max(F.struct("ingest_seq", "created_at", "content")).alias("r")).select("k", F.lit(False).alias("su"), F.col("r.created_at").alias("ts"), F.col("r.content").alias("text"))
    s = table(spark, sf_dir, "summaries").select(key("summary_id").alias("k"), F.lit(True).alias("su"), F.col("created_at").alias("ts"), F.col("content").alias("text"))
    # only keys and times are ranked; the texts join those that are shown
    every = m.unionByName(s)
    top = retrieval.top_per_group(n.join(every.select("k", "su", "ts"), ["k", "su"]), ["branch_id"], [F.col("ts").desc_nulls_last(), "k"], ENTRIES)
    return top.join(every.select("k", "su", "text"), ["k", "su"]).select("branch_id", F.col("k").alias("record_key"), "ts", "text")


def keyword_best_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP10: of every conversation the match that holds the phrase, else all terms, else the newest, with its surroundings."""
    m = keyword.matches(messages._messages(spark, sf_dir), messages.TERMS, messages.PHRASE)
    rank = F.struct(F.col("in_phrase").cast("int").alias("p"), (F.size("hits") == len(messages.TERMS)).cast("int").alias("a"), F.coalesce("created_at", F.lit(0.0)).alias("t"), "ingest_seq")
    best = m.groupBy("conversation_id").agg(F.max_by(F.struct("ingest_seq", "content", F.array_min(F.transform("hits", lambda h: h["pos"])).alias("pos")), rank).alias("b"))
    return best.select("conversation_id", F.col("b.ingest_seq").alias("ingest_seq"), keyword.snippet(F.col("b.content"), F.col("b.pos")).alias("snippet"))


def daily_log_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN6: the newest 50 log entries for each term of the query."""
    logs = table(spark, sf_dir, "daily_log_content").select(key("node_id").alias("node_key"), "text", "created_ts").where("node_key IS NOT NULL AND text IS NOT NULL")
    hits = logs.select("node_key", "created_ts", F.explode(F.filter(F.array(*[F.lit(t) for t in messages.TERMS]), lambda t: F.contains(F.lower("text"), t))).alias("term"))
    return retrieval.top_per_group(hits, ["term"], [F.col("created_ts").desc_nulls_last(), F.col("node_key")], 50).select("term", "node_key", "created_ts")


def last_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN4, FLT16: the last node of every branch and the number of its nodes."""
    n = nodes(spark, sf_dir).where("branch_id IS NOT NULL")
    last = F.max(F.struct(F.coalesce("timestamp", F.lit(0.0)).alias("t"), "ingest_seq", key("id").alias("id")))
    return n.groupBy("branch_id").agg(last.alias("l"), F.count(F.lit(1)).alias("nodes")).select("branch_id", F.col("l.id").alias("last_id"), F.col("l.ingest_seq").alias("last_seq"), "nodes")


def dag_parent_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4: condensed summaries linked to the summary nodes one level below in their conversation, as their number and ends."""
    s = table(spark, sf_dir, "summaries").select(key("summary_id").alias("k"), "conversation_id", "depth").where("k IS NOT NULL AND conversation_id IS NOT NULL")
    n = nodes(spark, sf_dir).where(F.col("node_type").isin("leaf_summary", "condensed_summary"))
    latest = n.groupBy(key("lcm_id").alias("k")).agg(F.max(F.struct("ingest_seq", key("id").alias("id"))).alias("m")).select("k", F.col("m.id").alias("node"))
    known = s.join(latest, "k")
    below = known.groupBy("conversation_id", (F.col("depth") + 1).alias("depth")).agg(F.count(F.lit(1)).alias("targets"), F.min("node").alias("least"), F.max("node").alias("greatest"))
    return known.where("depth > 0").join(below, ["conversation_id", "depth"]).select(F.col("node").alias("src"), "conversation_id", "targets", "least", "greatest")


QUERIES = {
    f.__name__: f
    for f in (source_scan, backfill_ends_and_stride, log_snippets, keyword_match_set, branch_source_ids, keyword_with_rank, text_search, content_fair_split, conversation_fallback, conversation_summaries, branch_texts, keyword_best_snippet, daily_log_terms, last_nodes, dag_parent_edges)
}

_B = Q.k("branch_id")
_Q = ", ".join(f"({i}, {x!r})" for i, x in enumerate(text_vector(messages.SEARCH), 1))
_ANY = " OR ".join(f"contains(lower(content), '{t}')" for t in messages.TERMS)
_GEO = f"""{Q.scored('balanced')}, tq AS (SELECT * FROM (VALUES {_Q}) AS v(i, qv)),
ts AS (SELECT branch_id, sum(qv * m) / ((sqrt(sum(qv * qv)) + 1e-9) * (sqrt(sum(m * m)) + 1e-9)) AS s FROM mu JOIN tq USING (i) GROUP BY 1),
tt AS (SELECT sc.branch_id, sc.state, sc.node_count, s, (0.60 * s + 0.25 * trust + 0.15 * 0.5 * s) * factor AS total FROM sc JOIN ts ON ts.branch_id = sc.branch_id)"""

ORACLE = {
    "conversation_summaries": f"""SELECT conversation_id, summary_id, depth, content FROM summaries WHERE conversation_id IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY depth DESC NULLS LAST, created_at DESC NULLS LAST, summary_id) <= {ENTRIES}""",
    "branch_texts": f"""WITH n AS (SELECT DISTINCT {_B} AS b, {Q.k('lcm_id')} AS k, contains(node_type, 'summary') AS su FROM memory_nodes WHERE {_B} IS NOT NULL),
e AS (SELECT {Q.k('message_id')} AS k, false AS su, arg_max(struct_pack(t := created_at), ingest_seq).t AS ts, arg_max(struct_pack(c := content), ingest_seq).c AS text FROM messages GROUP BY 1 UNION ALL SELECT {Q.k('summary_id')}, true, created_at, content FROM summaries)
SELECT b AS branch_id, k AS record_key, ts, text FROM n JOIN e USING (k, su) QUALIFY row_number() OVER (PARTITION BY b ORDER BY ts DESC NULLS LAST, k) <= {ENTRIES}""",
    "keyword_best_snippet": rf"""WITH {messages._HITS}, m AS (SELECT conversation_id, ingest_seq, any_value(content) AS content, any_value(created_at) AS t, any_value(in_phrase) AS p, count(*) AS c, min(pos) AS pos FROM hit GROUP BY 1, 2),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY p DESC, (c = {messages._N}) DESC, coalesce(t, 0) DESC, ingest_seq DESC) = 1)
SELECT conversation_id, ingest_seq, trim(regexp_replace(substr(content, greatest(pos - 100, 1), 260), '\s+', ' ', 'g')) AS snippet FROM b""",
    "daily_log_terms": f"""SELECT term, node_key, created_ts FROM (SELECT {Q.k('node_id')} AS node_key, text, created_ts FROM daily_log_content), {messages._T} WHERE node_key IS NOT NULL AND contains(lower(text), term)
QUALIFY row_number() OVER (PARTITION BY term ORDER BY created_ts DESC NULLS LAST, node_key) <= 50""",
    "last_nodes": f"""SELECT {_B} AS branch_id, arg_max({Q.k('id')}, (coalesce("timestamp", 0), ingest_seq)) AS last_id, arg_max(ingest_seq, (coalesce("timestamp", 0), ingest_seq)) AS last_seq, count(*) AS nodes FROM memory_nodes WHERE {_B} IS NOT NULL GROUP BY 1""",
    "dag_parent_edges": f"""WITH l AS (SELECT {Q.k('lcm_id')} AS k, arg_max({Q.k('id')}, ingest_seq) AS node FROM memory_nodes WHERE node_type IN ('leaf_summary', 'condensed_summary') GROUP BY 1),
s AS (SELECT node, conversation_id AS c, depth AS d FROM summaries JOIN l ON l.k = {Q.k('summary_id')} WHERE conversation_id IS NOT NULL), b AS (SELECT c, d + 1 AS d, count(*) AS targets, min(node) AS least, max(node) AS greatest FROM s GROUP BY 1, 2)
SELECT node AS src, c AS conversation_id, targets, least, greatest FROM s JOIN b USING (c, d) WHERE d > 0""",
    "source_scan": """SELECT kind, conversation_id, count(*) AS records, count(text) AS texts, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS signs, CAST(max(place) AS VARCHAR) AS last_place FROM (
  SELECT 'message' AS kind, coalesce(conversation_id, -1) AS conversation_id, seq AS place, content AS text FROM messages UNION ALL SELECT 'summary', coalesce(conversation_id, -1), depth, content FROM summaries) GROUP BY 1, 2""",
    "backfill_ends_and_stride": """WITH o AS (SELECT conversation_id, ingest_seq, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY conversation_id) AS n FROM messages WHERE conversation_id IS NOT NULL WINDOW w AS (PARTITION BY conversation_id ORDER BY coalesce(created_at, 0), ingest_seq)),
p AS (SELECT DISTINCT conversation_id, CAST(floor(j * (n / 200.0::DOUBLE)) AS BIGINT) AS r FROM (SELECT DISTINCT conversation_id, n FROM o WHERE n > 200), range(1, 199) AS g(j))
SELECT o.conversation_id, ingest_seq FROM o LEFT JOIN p ON p.conversation_id = o.conversation_id AND p.r = o.r WHERE n <= 200 OR o.r = 0 OR o.r = n - 1 OR p.r IS NOT NULL""",
    "log_snippets": rf"""WITH c AS (SELECT {Q.k('node_id')} AS node_key, trim(regexp_replace(coalesce(text, ''), '[\s\pZ]+', ' ', 'g')) AS t FROM daily_log_content)
SELECT node_key, CASE WHEN length(t) <= 240 THEN t ELSE rtrim(substr(t, 1, 239)) || '...' END AS snippet FROM c""",
    "keyword_match_set": f"WITH {messages._HITS} SELECT {Q.k('message_id')} AS message_key, term, max(ingest_seq) AS last_seq, count(*) AS deliveries FROM hit WHERE {Q.k('message_id')} IS NOT NULL GROUP BY 1, 2",
    "branch_source_ids": f"SELECT {_B} AS branch_id, {Q.k('lcm_id')} AS lcm_key, min(ingest_seq) AS first_seq FROM memory_nodes WHERE {_B} IS NOT NULL AND {Q.k('lcm_id')} IS NOT NULL GROUP BY 1, 2",
    "keyword_with_rank": f"""WITH s AS (SELECT branch_id, total, row_number() OVER (ORDER BY total DESC, branch_id) AS rank FROM ({branches.ORACLE['branch_rank_balanced']}))
SELECT conversation_id, score, coalesce(rank, 0) AS sem_rank, coalesce(total, 0.0) AS sem_total FROM ({messages.ORACLE['keyword_score']}) k LEFT JOIN s ON s.branch_id = 'conv_' || CAST(conversation_id AS VARCHAR)""",
    "text_search": f"""WITH {_GEO}, ranked AS (SELECT branch_id, s, round(total, 6) AS score FROM tt WHERE state NOT IN ('COLLAPSING', 'SPLIT_PENDING') ORDER BY round(tt.total, 6) DESC, branch_id LIMIT 5),
b AS (SELECT coalesce(round(max(s), 4), 0) AS s FROM ranked), f AS (SELECT count(*) AS n FROM messages WHERE conversation_id IS NOT NULL AND ({_ANY}))
SELECT 'geometry' AS channel, branch_id AS target, score FROM ranked
UNION ALL SELECT 'collapsing', branch_id, total FROM (SELECT branch_id, round(total, 6) AS total FROM tt WHERE state = 'COLLAPSING' AND node_count > 0 ORDER BY 2 DESC, branch_id LIMIT 5)
UNION ALL SELECT 'keyword', 'conv_' || CAST(conversation_id AS VARCHAR), score FROM (SELECT * FROM ({messages.ORACLE['keyword_score']}) ORDER BY score DESC, phrase_messages DESC, covered DESC, conversation_id LIMIT 5)
UNION ALL SELECT 'daily_log', node_key, 0.0 FROM (SELECT * FROM ({messages.ORACLE['daily_log_keyword']}) ORDER BY created_ts DESC, node_key LIMIT 5)
UNION ALL SELECT 'recommendation', CASE WHEN n = 0 AND s > 0.30 THEN 'geometry' WHEN s < 0.25 THEN 'keyword' WHEN n > 0 AND s > 0.30 THEN 'both' ELSE 'geometry' END, s FROM b, f""",
    "content_fair_split": f"""WITH b AS (SELECT {_B} AS b, last_update_ts AS u FROM branch_states WHERE {_B} LIKE 'conv%' ORDER BY last_update_ts DESC NULLS LAST, 1 LIMIT {SHOWN}),
pl AS (SELECT b, row_number() OVER (ORDER BY u DESC NULLS LAST, b) AS place FROM b),
n AS (SELECT DISTINCT {_B} AS b, {Q.k('lcm_id')} AS k, node_type IN ('leaf_summary', 'condensed_summary') AS su FROM memory_nodes WHERE node_type IN ('leaf_summary', 'condensed_summary', 'message', 'tool_result')),
c AS (SELECT n.b, count(*) FILTER (su AND k IN (SELECT {Q.k('summary_id')} FROM summaries)) AS s, count(*) FILTER (NOT su AND k IN (SELECT {Q.k('message_id')} FROM messages)) AS m FROM n GROUP BY 1),
t AS (SELECT place, pl.b, coalesce(s, 0) AS s, coalesce(m, 0) AS m, least(CASE WHEN coalesce(s, 0) > 0 THEN s ELSE coalesce(m, 0) END, {max(ENTRIES // SHOWN, LEAST)}) AS take FROM pl LEFT JOIN c USING (b)),
e AS (SELECT *, greatest(least(take, {ENTRIES} - coalesce(sum(take) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 0) AS entries FROM t)
SELECT place, b AS branch_id, CAST(entries AS BIGINT) AS entries, concat_ws('; ', CASE WHEN s = 0 AND m > 0 THEN 'summary_empty_used_messages_fallback' END, CASE WHEN entries < take THEN 'trimmed' END) AS warning FROM e""",
    "conversation_fallback": f"""WITH b AS (SELECT {_B} AS branch_id, state, last_update_ts AS t FROM branch_states WHERE {_B} LIKE 'conv\\_%' ESCAPE '\\'), a AS (SELECT * FROM b WHERE state = 'ACTIVE' AND t > 0 AND t >= {AS_OF} - 0.02 * 86400)
SELECT branch_id, state, 'none' AS reason FROM a UNION ALL SELECT branch_id, state, 'active_recent_empty_used_working_group' FROM b WHERE state IN ({', '.join(f"'{s}'" for s in WORKING)}) AND NOT EXISTS (SELECT 1 FROM a)""",
}
