"""Queries on whole records: redelivery, hierarchies, orphan references, dominant keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.keys import key
from thicket.operators import hierarchy, orphans, redelivery, skew
from thicket.session import Scratch, table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of redelivered messages to remove."""
    rows = table(spark, sf_dir, "memory_nodes").where("node_type = 'message'")
    gone = redelivery.repeats(rows, [key("branch_id"), key("lcm_id")], "ingest_seq", "timestamp")
    return gone.select(F.col("seq").alias("ingest_seq"))


def p4_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages kept per branch after redelivered copies are removed."""
    rows = table(spark, sf_dir, "memory_nodes").where("node_type = 'message'").select("ingest_seq", "timestamp", "branch_id", "lcm_id")
    kept = redelivery.keep_one(rows, [key("branch_id"), key("lcm_id")], "ingest_seq", "timestamp")
    return kept.groupBy(key("branch_id").alias("branch_id")).agg(
        F.count(F.lit(1)).alias("messages"), F.min("ingest_seq").alias("first_seq"), F.max("ingest_seq").alias("last_seq")
    )


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "memory_nodes").select(
        key("id").alias("key"), "id", F.col("ingest_seq").alias("seq"), key("parent_id").alias("parent"),
        key("correction_prev_id").alias("prev"), key("correction_root_id").alias("croot"),
    )
    return Scratch(spark, "nodes").save(hierarchy.number_nodes(rows, ["parent", "prev"], ["croot"]), "numbered")


def _both_links(nodes: DataFrame, with_paths: bool = False) -> DataFrame:
    """The forest of parents and that of corrections in one contraction: even and odd numbers."""
    parts = []
    for bit, link in enumerate(("parent", "prev")):
        e = hierarchy.link_edges(nodes, link)
        parts.append(e.select((F.col("nid") * 2 + bit).alias("nid"), (F.col("pid") * 2 + bit).alias("pid"), "dangling"))
    out = hierarchy.contract(parts[0].unionByName(parts[1]), with_paths)
    half = lambda c: F.expr(f"{c} div 2")
    cols = [half("nid").alias("nid"), half("root").alias("root"), "depth", "end", "on_cycle", (F.col("size") - 1).alias("descendants")]
    if with_paths:
        cols.append(F.transform("path", lambda x: F.floor(x / 2)).alias("path"))
    return out.select((F.col("nid") % 2 == 1).alias("correction"), *cols)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on circles of links, and versions whose named root is not the end of their chain."""
    nodes = _numbered(spark, sf_dir)
    placed = _both_links(nodes)
    ids = nodes.select("nid", "id", "croot")
    circles = placed.where("on_cycle").select(
        "nid", F.when(F.col("correction"), "correction_cycle").otherwise("parent_cycle").alias("kind")
    )
    ends = placed.where("correction AND depth > 0 AND end = 'root'").select("nid", "root")
    roots = nodes.select(F.col("nid").alias("root"), F.col("key").alias("root_key"))
    known = skew.skew_join(ends, roots, "root", "inner", skew.heavy_keys(ends, "root", 0.005), row_hash=F.col("nid")).select("nid", "root_key")
    wrong = known.join(ids.select("nid", "croot"), "nid").where(~F.col("croot").eqNullSafe(F.col("root_key")))
    found = circles.unionByName(wrong.select("nid", F.lit("root_mismatch").alias("kind")))
    return found.join(ids.select("nid", "id"), "nid").select("kind", "id")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Scratch(spark, "placed").save(_both_links(_numbered(spark, sf_dir), with_paths=True), "placed")


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and number of descendants of every node along both kinds of links.

    The descendants are counted in the contraction itself; depth and path of nodes of and below a circle are counted from
    the core of the circle, whichever node that is, and so are not given (-1 and null, as is the root they lack: -1).
    """
    placed = _both_links(_numbered(spark, sf_dir), with_paths=True)
    open_ = F.col("end") != "cycle"
    return placed.select(
        F.when(F.col("correction"), "correction").otherwise("parent").alias("link"), "nid", F.coalesce("root", F.lit(-1)).alias("root"), F.when(open_, F.col("depth")).otherwise(-1).alias("depth"), "end", "on_cycle",
        F.when(open_, F.concat_ws("/", F.transform("path", lambda x: x.cast("string")))).alias("path"), "descendants",
    )


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descendants of every node along both kinds of links: (link, ancestor, nid, distance)."""
    below = hierarchy.descendants(_placed(spark, sf_dir).select("nid", "path", "correction", "on_cycle"))
    return below.select(F.when(F.col("correction"), "correction").otherwise("parent").alias("link"), "ancestor", "nid", F.col("distance").cast("long").alias("distance"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "memory_edges")
    ends = edges.select("edge_seq", "created_ts", F.explode(F.map_from_arrays(F.array(F.lit("src_id"), F.lit("dst_id")), F.array("src_id", "dst_id"))).alias("ref_field", "raw"))
    ends = ends.select(
        F.lit("memory_edges").alias("ref_table"), "ref_field", F.col("edge_seq").alias("row_seq"), F.col("created_ts").alias("ref_ts"),
        F.lit("memory_nodes").alias("target"), key("raw").alias("key"),
    ).where(~F.coalesce(F.col("key").startswith("agent:"), F.lit(False)))
    target = F.when(F.col("node_type").isin("message", "tool_result"), "messages").when(
        F.col("node_type").isin("leaf_summary", "condensed_summary"), "summaries"
    )
    lcm = table(spark, sf_dir, "memory_nodes").select(
        F.lit("memory_nodes").alias("ref_table"), F.lit("lcm_id").alias("ref_field"), F.col("ingest_seq").alias("row_seq"),
        F.col("timestamp").alias("ref_ts"), target.alias("target"), key("lcm_id").alias("key"),
    ).where("target IS NOT NULL")
    return ends.unionByName(lcm)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    purges = t("purged_records")
    of = lambda df, target: df.select(F.lit(target).alias("target"), "key")
    nodes = orphans.live(t("memory_nodes"), "id", "timestamp", purges, "memory_nodes")
    branches = orphans.live(t("branch_states"), "branch_id", None)
    messages = orphans.live(t("messages"), "message_id", "created_at", purges, "messages")
    summaries = orphans.live(t("summaries"), "summary_id", "created_at", purges, "summaries")
    return of(nodes, "memory_nodes").unionByName(of(branches, "memory_nodes")).unionByName(of(messages, "messages")).unionByName(of(summaries, "summaries"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References without a record: what the cascade finds at its first level, the direct orphans."""
    return _all_orphans(spark, sf_dir).where("kind = 'direct'").select("ref_field", "row_seq")


def _all_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct orphans, and what hangs on them: nodes below an orphaned node and edges that touch one."""
    scratch = Scratch(spark, "inherited")
    refs = _references(spark, sf_dir)
    hit = scratch.save(orphans.direct(refs, _records(spark, sf_dir)), "direct")
    raw = table(spark, sf_dir, "memory_nodes").select(key("id").alias("key"), key("parent_id").alias("parent"), F.col("ingest_seq").alias("row_seq"), F.col("timestamp").alias("ref_ts"))
    raw = raw.where("key IS NOT NULL")
    tree = raw.groupBy("key").agg(F.min(F.struct("row_seq", "parent")).alias("r")).select("key", "r.parent")
    bad = raw.join(hit.where("ref_field = 'lcm_id'").select("row_seq"), "row_seq", "left_semi").select("key").distinct()
    spoiled = scratch.save(orphans.cascade(tree, bad), "spoiled")
    first = F.lit("direct").alias("kind"), F.lit(0).cast("long").alias("levels")
    cols = ["ref_table", "ref_field", "row_seq", "ref_ts", "kind", "levels"]
    direct = hit.select("*", *first).select(cols)
    below = raw.join(spoiled.where("levels > 0"), "key").select(
        F.lit("memory_nodes").alias("ref_table"), F.lit("parent_id").alias("ref_field"), "row_seq", "ref_ts", F.lit("inherited").alias("kind"), "levels"
    )
    ends = refs.where("ref_table = 'memory_edges'")
    touched = ends.join(spoiled, "key").join(hit.select("ref_field", "row_seq"), ["ref_field", "row_seq"], "left_anti")
    touched = touched.select("ref_table", "ref_field", "row_seq", "ref_ts", F.lit("inherited").alias("kind"), (F.col("levels") + 1).alias("levels"))
    return direct.unionByName(below).unionByName(touched)


def p6_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and edges that are orphans, directly or by inheritance along every foreign key, per table and key they inherited by.

    Direct orphans are nodes whose lcm_id has no record, purged nodes that are still there, and messages without listed
    conversation. Nodes inherit from their parent, from the version before and from their message; edges from both ends.
    """
    t = lambda name: table(spark, sf_dir, name)
    scratch = Scratch(spark, "graph")
    raw = t("memory_nodes").select(key("id").alias("id"), key("parent_id").alias("parent"), key("correction_prev_id").alias("prev"), key("lcm_id").alias("lcm"), "node_type", F.col("ingest_seq").alias("seq"))
    first = raw.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("seq", "parent", "prev", "lcm", "node_type")).alias("r")).select("id", "r.*")
    first = scratch.save(first, "nodes")
    node, message = (lambda c, p=p: F.concat(F.lit(p), c) for p in ("n:", "m:"))
    hit = orphans.direct(_references(spark, sf_dir).where("ref_field = 'lcm_id'"), _records(spark, sf_dir)).select(F.col("row_seq").alias("seq"))
    gone = first.select(F.col("id").alias("key")).join(orphans.live(t("memory_nodes"), "id", "timestamp", t("purged_records"), "memory_nodes"), "key", "left_anti")
    stray = t("messages").select(key("message_id").alias("key"), "conversation_id").where("key IS NOT NULL").join(t("conversations").select("conversation_id"), "conversation_id", "left_anti")
    begin = raw.join(hit, "seq", "left_semi").where("id IS NOT NULL").select(node(F.col("id")).alias("key")).unionByName(gone.select(node(F.col("key")).alias("key"))).unionByName(stray.select(message(F.col("key")).alias("key")))
    up = lambda c, to: first.where(F.col(c).isNotNull()).select(node(F.col("id")).alias("key"), to(F.col(c)).alias("parent"))
    links = {
        "parent_id": up("parent", node), "correction_prev_id": up("prev", node),
        "lcm_id": first.where("lcm IS NOT NULL AND node_type IN ('message', 'tool_result')").select(node(F.col("id")).alias("key"), message(F.col("lcm")).alias("parent")),
    }
    known = scratch.save(orphans.fixpoint(begin, links), "known")
    name = F.when(F.col("key").startswith("n:"), "memory_nodes").otherwise("messages")
    records = known.select(name.alias("ref_table"), F.when(F.col("via") == "direct", "direct").otherwise("inherited").alias("kind"))
    e = t("memory_edges").select("edge_seq", F.explode(F.array(node(key("src_id")), node(key("dst_id")))).alias("key"))
    edges = e.join(known, "key", "left_semi").select("edge_seq").distinct().select(F.lit("memory_edges").alias("ref_table"), F.lit("inherited").alias("kind"))
    return records.unionByName(edges).groupBy("ref_table", "kind").agg(F.count(F.lit(1)).alias("orphans"))


def p6_orphan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and inherited orphans per table, field and month."""
    return orphans.report(_all_orphans(spark, sf_dir), F.col("ref_ts"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys above 2.5 % of all rows of their table."""
    messages = table(spark, sf_dir, "messages").select(F.col("conversation_id").alias("k"))
    nodes = table(spark, sf_dir, "memory_nodes").select(key("branch_id").alias("k"))
    out = None
    for field, df in (("messages.conversation_id", messages), ("memory_nodes.branch_id", nodes)):
        part = skew.dominant(df, "k").select(F.lit(field).alias("field"), F.col("key").alias("key_value"))
        out = part if out is None else out.unionByName(part)
    return out


def p7_conversation_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation: rows, speakers' rows, tokens and the longest wait since the conversation began."""
    m = table(spark, sf_dir, "messages").select("conversation_id", "token_count", "created_at", "ingest_seq")
    c = table(spark, sf_dir, "conversations").select("conversation_id", F.col("created_at").alias("started"))
    return skew.per_key(
        m, "conversation_id",
        partial={"n": F.count(F.lit(1)), "tokens": F.sum("token_count"), "span": F.max(F.col("created_at") - F.col("started")), "late": F.sum((F.col("created_at") < F.col("started")).cast("long"))},
        final={"messages": F.sum("n"), "tokens": F.coalesce(F.sum("tokens"), F.lit(0)), "span_s": F.max("span"), "before_start": F.coalesce(F.sum("late"), F.lit(0))},
        match=c, match_key="conversation_id", row_hash=F.xxhash64("ingest_seq"),
    )


def p7_branch_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per branch: nodes, tokens and nodes newer than the branch's last update."""
    n = table(spark, sf_dir, "memory_nodes").select(key("branch_id").alias("branch_id"), "token_count", "timestamp", "ingest_seq")
    b = table(spark, sf_dir, "branch_states").select(key("branch_id").alias("bid"), "last_update_ts", F.col("node_count").cast("double").alias("stated"))
    return skew.per_key(
        n, "branch_id",
        partial={"n": F.count(F.lit(1)), "tokens": F.sum("token_count"), "newer": F.sum((F.col("timestamp") > F.col("last_update_ts")).cast("long")), "stated": F.max("stated")},
        final={"nodes": F.sum("n"), "tokens": F.coalesce(F.sum("tokens"), F.lit(0)), "newer": F.coalesce(F.sum("newer"), F.lit(0)), "stated": F.max("stated")},
        match=b, match_key="bid", row_hash=F.xxhash64("ingest_seq"),
    )


QUERIES = {
    f.__name__: f
    for f in (p4_found, p4_deliveries, p5_found, p5_hierarchy, p5_descendants, p6_found, p6_orphan_report, p6_cascade, p7_found, p7_conversation_loads, p7_branch_loads)
}

_K = r"nullif(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), '')"
_k = lambda c: _K.replace("{c}", c)

_NODES = f"""WITH RECURSIVE rowsk AS (
  SELECT {_k('id')} AS k, id, ingest_seq, {_k('parent_id')} AS parent, {_k('correction_prev_id')} AS prev, {_k('correction_root_id')} AS croot
  FROM memory_nodes),
n AS (SELECT * FROM rowsk WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY ingest_seq) = 1)"""

_LIVE = f"""purges AS (SELECT lower(trim(record_table)) AS t, {_k('record_key')} AS k, max(purged_ts) AS p FROM purged_records GROUP BY 1, 2),
own AS (
  SELECT 'memory_nodes' AS t, {_k('id')} AS k, max("timestamp") AS ts FROM memory_nodes GROUP BY 1, 2
  UNION ALL SELECT 'messages', {_k('message_id')}, max(created_at) FROM messages GROUP BY 1, 2
  UNION ALL SELECT 'summaries', {_k('summary_id')}, max(created_at) FROM summaries GROUP BY 1, 2),
live AS (SELECT own.t, own.k FROM own LEFT JOIN purges USING (t, k) WHERE purges.p IS NULL OR own.ts > purges.p
  UNION SELECT 'memory_nodes', {_k('branch_id')} FROM branch_states),
refs AS (
  SELECT 'memory_edges' AS ref_table, 'src_id' AS ref_field, edge_seq AS row_seq, created_ts AS ref_ts, 'memory_nodes' AS t, {_k('src_id')} AS k FROM memory_edges
  UNION ALL SELECT 'memory_edges', 'dst_id', edge_seq, created_ts, 'memory_nodes', {_k('dst_id')} FROM memory_edges
  UNION ALL SELECT 'memory_nodes', 'lcm_id', ingest_seq, "timestamp", CASE WHEN node_type IN ('message', 'tool_result') THEN 'messages' ELSE 'summaries' END, {_k('lcm_id')}
  FROM memory_nodes WHERE node_type IN ('message', 'tool_result', 'leaf_summary', 'condensed_summary')),
missing AS (SELECT refs.* FROM refs ANTI JOIN live USING (t, k) WHERE k IS NOT NULL AND k NOT LIKE 'agent:%')"""

_LINKS = """named AS (SELECT 'parent' AS link, k, ingest_seq AS nid, parent AS pk FROM n UNION ALL SELECT 'correction', k, ingest_seq, prev FROM n),
e AS (SELECT named.link, named.nid, named.pk, q.ingest_seq AS pid FROM named LEFT JOIN n q ON named.pk = q.k),
walk AS (SELECT link, nid, pid AS a, 1 AS hops, [nid] AS seen FROM e WHERE pid IS NOT NULL AND pid <> nid
  UNION ALL SELECT walk.link, walk.nid, e.pid, hops + 1, list_append(seen, walk.a) FROM walk JOIN e ON e.link = walk.link AND e.nid = walk.a WHERE e.pid IS NOT NULL AND e.pid <> walk.a AND NOT list_contains(walk.seen, e.pid))"""

ORACLE = {
    "p5_descendants": f"{_NODES}, {_LINKS} SELECT link, a AS ancestor, nid, CAST(hops AS BIGINT) AS distance FROM walk",
    "p5_hierarchy": f"""{_NODES}, {_LINKS},
tree AS (SELECT link, nid, nid AS root, 0 AS depth, CASE WHEN pk IS NULL THEN 'root' ELSE 'dangling' END AS ends, CAST(nid AS VARCHAR) AS path FROM e WHERE pid IS NULL
  UNION ALL SELECT e.link, e.nid, root, depth + 1, ends, path || '/' || CAST(e.nid AS VARCHAR) FROM tree JOIN e ON e.link = tree.link AND e.pid = tree.nid),
reach AS (SELECT link, nid AS s, pid AS c FROM e WHERE pid IS NOT NULL UNION SELECT reach.link, reach.s, e.pid FROM reach JOIN e ON e.link = reach.link AND e.nid = reach.c WHERE e.pid IS NOT NULL),
below AS (SELECT link, a AS nid, count(*) AS descendants FROM walk GROUP BY 1, 2),
circles AS (SELECT link, s AS nid FROM reach WHERE s = c)
SELECT e.link, e.nid, coalesce(tree.root, -1) AS root, CAST(coalesce(tree.depth, -1) AS BIGINT) AS depth, coalesce(tree.ends, 'cycle') AS "end", circles.nid IS NOT NULL AS on_cycle, tree.path, coalesce(descendants, 0) AS descendants
FROM e LEFT JOIN tree USING (link, nid) LEFT JOIN below USING (link, nid) LEFT JOIN circles USING (link, nid)""",
    "p4_found": f"""SELECT ingest_seq FROM memory_nodes WHERE node_type = 'message' AND {_k('branch_id')} IS NOT NULL AND {_k('lcm_id')} IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY {_k('branch_id')}, {_k('lcm_id')} ORDER BY ingest_seq) > 1""",
    "p4_deliveries": f"""SELECT b AS branch_id, count(*) AS messages, min(s) AS first_seq, max(s) AS last_seq FROM (
  SELECT {_k('branch_id')} AS b, {_k('lcm_id')} AS l, min(ingest_seq) AS s FROM memory_nodes WHERE node_type = 'message' GROUP BY 1, 2) GROUP BY 1""",
    "p5_found": f"""{_NODES},
up AS (SELECT k AS s, parent AS c FROM n WHERE parent IS NOT NULL UNION SELECT up.s, n.parent FROM up JOIN n ON up.c = n.k WHERE n.parent IS NOT NULL),
cu AS (SELECT k AS s, prev AS c FROM n WHERE prev IS NOT NULL UNION SELECT cu.s, n.prev FROM cu JOIN n ON cu.c = n.k WHERE n.prev IS NOT NULL),
ends AS (SELECT cu.s, cu.c FROM cu JOIN n ON cu.c = n.k WHERE n.prev IS NULL)
SELECT 'parent_cycle' AS kind, n.id FROM up JOIN n ON up.s = n.k WHERE up.s = up.c
UNION ALL SELECT 'correction_cycle', n.id FROM cu JOIN n ON cu.s = n.k WHERE cu.s = cu.c
UNION ALL SELECT 'root_mismatch', n.id FROM ends JOIN n ON ends.s = n.k WHERE n.croot IS DISTINCT FROM ends.c""",
    "p6_found": f"WITH {_LIVE} SELECT ref_field, row_seq FROM missing",
    "p6_orphan_report": f"""WITH RECURSIVE {_LIVE},
raw AS (SELECT {_k('id')} AS k, {_k('parent_id')} AS parent, ingest_seq AS row_seq, "timestamp" AS ref_ts FROM memory_nodes WHERE {_k('id')} IS NOT NULL),
tree AS (SELECT k, parent FROM raw QUALIFY row_number() OVER (PARTITION BY k ORDER BY row_seq) = 1),
bad AS (SELECT DISTINCT raw.k FROM raw JOIN missing ON missing.ref_field = 'lcm_id' AND missing.row_seq = raw.row_seq),
spoiled AS (SELECT k FROM bad UNION SELECT tree.k FROM tree JOIN spoiled ON tree.parent = spoiled.k),
every AS (
  SELECT ref_table, ref_field, 'direct' AS kind, ref_ts FROM missing
  UNION ALL SELECT 'memory_nodes', 'parent_id', 'inherited', ref_ts FROM raw WHERE k IN (SELECT k FROM spoiled) AND k NOT IN (SELECT k FROM bad)
  UNION ALL SELECT ref_table, ref_field, 'inherited', ref_ts FROM refs WHERE ref_table = 'memory_edges' AND k IN (SELECT k FROM spoiled) AND (ref_field, row_seq) NOT IN (SELECT (ref_field, row_seq) FROM missing))
SELECT ref_table, ref_field, kind, coalesce(strftime(make_timestamp(CAST(floor(ref_ts) * 1000000 AS BIGINT)), '%Y-%m'), 'unknown') AS month, count(*) AS orphans FROM every GROUP BY 1, 2, 3, 4""",
    "p6_cascade": f"""WITH RECURSIVE {_LIVE},
first AS (SELECT {_k('id')} AS id, {_k('parent_id')} AS parent, {_k('correction_prev_id')} AS prev, {_k('lcm_id')} AS lcm, node_type FROM memory_nodes WHERE {_k('id')} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_k('id')} ORDER BY ingest_seq) = 1),
stray AS (SELECT DISTINCT {_k('message_id')} AS k FROM messages ANTI JOIN conversations USING (conversation_id) WHERE conversation_id IS NOT NULL AND {_k('message_id')} IS NOT NULL),
strayed AS (SELECT * FROM stray UNION SELECT {_k('message_id')} FROM messages WHERE conversation_id IS NULL AND {_k('message_id')} IS NOT NULL),
begin AS (SELECT DISTINCT 'n:' || {_k('id')} AS k FROM memory_nodes JOIN missing ON missing.ref_field = 'lcm_id' AND row_seq = ingest_seq WHERE {_k('id')} IS NOT NULL
  UNION SELECT 'n:' || id FROM first WHERE id NOT IN (SELECT k FROM live WHERE t = 'memory_nodes' AND k IS NOT NULL AND k NOT IN (SELECT {_k('branch_id')} FROM branch_states WHERE {_k('branch_id')} IS NOT NULL))
  UNION SELECT 'm:' || k FROM strayed),
up AS (SELECT 'n:' || id AS k, 'n:' || parent AS p FROM first WHERE parent IS NOT NULL UNION ALL SELECT 'n:' || id, 'n:' || prev FROM first WHERE prev IS NOT NULL
  UNION ALL SELECT 'n:' || id, 'm:' || lcm FROM first WHERE lcm IS NOT NULL AND node_type IN ('message', 'tool_result')),
spoiled AS (SELECT k FROM begin UNION SELECT up.k FROM up JOIN spoiled ON up.p = spoiled.k),
every AS (SELECT CASE WHEN k LIKE 'n:%' THEN 'memory_nodes' ELSE 'messages' END AS ref_table, CASE WHEN k IN (SELECT k FROM begin) THEN 'direct' ELSE 'inherited' END AS kind FROM spoiled
  UNION ALL SELECT 'memory_edges', 'inherited' FROM memory_edges WHERE 'n:' || {_k('src_id')} IN (SELECT k FROM spoiled) OR 'n:' || {_k('dst_id')} IN (SELECT k FROM spoiled))
SELECT ref_table, kind, count(*) AS orphans FROM every GROUP BY 1, 2""",
    "p7_found": f"""SELECT 'messages.conversation_id' AS field, CAST(conversation_id AS VARCHAR) AS key_value FROM messages WHERE conversation_id IS NOT NULL
GROUP BY 2 HAVING count(*) > 0.025 * (SELECT count(*) FROM messages)
UNION ALL SELECT 'memory_nodes.branch_id', {_k('branch_id')} FROM memory_nodes WHERE {_k('branch_id')} IS NOT NULL
GROUP BY 2 HAVING count(*) > 0.025 * (SELECT count(*) FROM memory_nodes)""",
    "p7_conversation_loads": """SELECT m.conversation_id, count(*) AS messages, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens, max(m.created_at - c.created_at) AS span_s,
  CAST(coalesce(sum(CASE WHEN m.created_at < c.created_at THEN 1 ELSE 0 END) FILTER (WHERE c.created_at IS NOT NULL), 0) AS BIGINT) AS before_start
FROM messages m LEFT JOIN conversations c USING (conversation_id) WHERE m.conversation_id IS NOT NULL GROUP BY 1""",
    "p7_branch_loads": f"""SELECT k AS branch_id, count(*) AS nodes, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens,
  CAST(coalesce(sum(CASE WHEN "timestamp" > last_update_ts THEN 1 ELSE 0 END), 0) AS BIGINT) AS newer, max(stated) AS stated
FROM (SELECT {_k('branch_id')} AS k, token_count, "timestamp" FROM memory_nodes) LEFT JOIN (SELECT {_k('branch_id')} AS k, last_update_ts, CAST(node_count AS DOUBLE) AS stated FROM branch_states) USING (k)
WHERE k IS NOT NULL GROUP BY 1""",
}
