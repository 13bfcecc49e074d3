"""Checks and repairs of the graph of nodes, edges and branches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.keys import key
from thicket.operators import lineage


def _ids(nodes: DataFrame) -> DataFrame:
    return nodes.select(key("id").alias("k")).where("k IS NOT NULL").distinct()


def orphan_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per edge type: edges, those whose source, target or either is no node.

    Distinct (type, source, target) triples are counted first, so repeated edges cost one row.
    """
    e = edges.select("edge_type", key("src_id").alias("s"), key("dst_id").alias("d")).groupBy("edge_type", "s", "d").agg(F.count(F.lit(1)).alias("n"))
    ids = _ids(nodes)
    known = lambda c, f: ids.select(F.col("k").alias(c), F.lit(True).alias(f))
    j = e.join(known("s", "has_s"), "s", "left").join(known("d", "has_d"), "d", "left")
    no_s, no_d = F.col("has_s").isNull(), F.col("has_d").isNull()
    add = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return j.groupBy("edge_type").agg(F.sum("n").alias("edges"), add(no_s).alias("no_source"), add(no_d).alias("no_target"), add(no_s | no_d).alias("orphans"))


def topology(conversations: DataFrame, branches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(problem, rows): conversations, branches and nodes whose counterpart is missing."""
    c = conversations.select(F.concat(F.lit("conv_"), F.col("conversation_id").cast("string")).alias("branch_id"))
    b = branches.select("branch_id")
    n = nodes.groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"))
    one = lambda df, name, total: df.agg(total.alias("rows")).select(F.lit(name).alias("problem"), F.coalesce("rows", F.lit(0)).alias("rows"))
    count = F.count(F.lit(1))
    return (
        one(c.join(b, "branch_id", "left_anti"), "conversation_without_branch", count)
        .unionByName(one(b.where(F.col("branch_id").startswith("conv_")).join(c, "branch_id", "left_anti"), "branch_without_conversation", count))
        .unionByName(one(n.join(b, "branch_id", "left_anti"), "node_without_branch", F.sum("n")))
    )


def relabel(edges: DataFrame, nodes: DataFrame, old: str = "contradicts", new: str = "topic_drift") -> DataFrame:
    """(edge_seq, edge_type): edges of the old type that neither a correction nor a parent link backs get the new one."""
    e = edges.where(F.col("edge_type") == old).select("edge_seq", key("src_id").alias("s"), key("dst_id").alias("d"))
    links = nodes.select(key("id").alias("k"), key("correction_prev_id").alias("p"), key("parent_id").alias("u"))
    backed = links.where("p IS NOT NULL").select(F.col("k").alias("s"), F.col("p").alias("d")).unionByName(links.where("u IS NOT NULL").select(F.col("u").alias("s"), F.col("k").alias("d")))
    backed = backed.distinct().withColumn("backed", F.lit(True))
    out = e.join(backed, ["s", "d"], "left")
    return out.select("edge_seq", F.when(F.col("backed"), old).otherwise(new).alias("edge_type"))


def last_write(edges: DataFrame) -> DataFrame:
    """One row per (src, dst, edge_type): the one with the highest edge_seq."""
    w = F.max(F.struct("edge_seq", "weight")).alias("m")
    per = edges.groupBy(key("src_id").alias("src"), key("dst_id").alias("dst"), "edge_type").agg(w)
    return per.select("src", "dst", "edge_type", F.col("m.weight").alias("weight"), F.col("m.edge_seq").alias("edge_seq"))


def rewire(nodes: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Remaining nodes whose links named a removed copy, with the links led to the node that stays."""
    to = duplicates.where("id <> keep_id").groupBy("id").agg(F.min("keep_id").alias("keep"))
    n = nodes.select("ingest_seq", key("id").alias("id"), key("parent_id").alias("parent_id"), key("correction_prev_id").alias("correction_prev_id"), key("correction_root_id").alias("correction_root_id"))
    n = n.join(duplicates.select("ingest_seq"), "ingest_seq", "left_anti")
    links = ("parent_id", "correction_prev_id", "correction_root_id")
    for c in links:
        # a null link asks with a number of its own, so that nulls do not meet in one task
        n = n.withColumn("_a", F.coalesce(c, F.concat(F.lit("\x00"), F.col("ingest_seq").cast("string"))))
        n = n.join(to.select(F.col("id").alias("_a"), F.col("keep").alias(f"_{c}")), "_a", "left").drop("_a")
    changed = F.col("_parent_id").isNotNull() | F.col("_correction_prev_id").isNotNull() | F.col("_correction_root_id").isNotNull()
    return n.where(changed).select("ingest_seq", "id", *[F.coalesce(f"_{c}", c).alias(c) for c in links])


def cleaned_edges(edges: DataFrame, nodes: DataFrame, duplicates: DataFrame) -> DataFrame:
    """(src_id, dst_id, edge_type, weight): the edges after removed copies are gone from ``nodes``.

    Edges that touch a removed id (one that no remaining row has) go; temporal edges and those of corrections are built anew
    from what remains.
    """
    rest = nodes.join(duplicates.select("ingest_seq"), "ingest_seq", "left_anti")
    gone = duplicates.select(F.col("id").alias("k")).distinct().join(_ids(rest), "k", "left_anti")
    kept = edges_apart(edges.where(~F.col("edge_type").isin("temporal_next", "refines", "contradicts", "supersedes")), gone)
    kept = kept.select(key("src_id").alias("src_id"), key("dst_id").alias("dst_id"), "edge_type", "weight")
    one = F.lit(1.0).alias("weight")
    order = lineage.temporal_edges(rest).select(key("src_id").alias("src_id"), key("dst_id").alias("dst_id"), F.lit("temporal_next").alias("edge_type"), one)
    chains = lineage.correction_chains(rest.where("node_type = 'message'")).where("prev_id IS NOT NULL").join(rest.select("ingest_seq", "conflict_score"), "ingest_seq")
    kinds = F.create_map(*[F.lit(x) for x in ("refine", "refines", "contradict", "contradicts", "supersede", "supersedes")])
    weight = F.when(F.col("kind") == "refine", 1.0).otherwise(F.greatest(F.lit(0.01), F.coalesce("conflict_score", F.lit(0.0))))
    fixed = chains.select(key("id").alias("src_id"), key("prev_id").alias("dst_id"), kinds[F.col("kind")].alias("edge_type"), weight.alias("weight"))
    return kept.unionByName(order).unionByName(fixed)


def dag_edges(summaries: DataFrame, messages: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per leaf summary: the latest message nodes of its conversation (their number and ends).

    The edges of a summary share their targets with all summaries of its conversation, so they are
    kept as (source, conversation) and (conversation, target) and only counted here.
    """
    summary = F.col("node_type").isin("leaf_summary", "condensed_summary")
    latest = nodes.where(summary | (F.col("node_type") == "message")).groupBy(key("lcm_id").alias("k"), summary.alias("is_summary")).agg(F.max(F.struct("ingest_seq", key("id").alias("id"))).alias("m"))
    latest = latest.select("k", "is_summary", F.col("m.id").alias("node"))
    s = summaries.where("depth = 0").select(key("summary_id").alias("k"), "conversation_id").join(latest.where("is_summary"), "k").select(F.col("node").alias("src"), "conversation_id")
    m = messages.select(key("message_id").alias("k"), "conversation_id").where("k IS NOT NULL").distinct().join(latest.where("NOT is_summary"), "k")
    per = m.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("targets"), F.min("node").alias("least"), F.max("node").alias("greatest"))
    return s.join(per, "conversation_id").select("src", "conversation_id", "targets", "least", "greatest")


def edges_within(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends in the set (column k)."""
    e = edges.withColumn("_s", key("src_id")).withColumn("_d", key("dst_id"))
    return e.join(ids.select(F.col("k").alias("_s")), "_s", "left_semi").join(ids.select(F.col("k").alias("_d")), "_d", "left_semi").drop("_s", "_d")


def edges_apart(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with no end in the set (column k): what stays when all edges that touch it go."""
    e = edges.withColumn("_s", key("src_id")).withColumn("_d", key("dst_id"))
    return e.join(ids.select(F.col("k").alias("_s")), "_s", "left_anti").join(ids.select(F.col("k").alias("_d")), "_d", "left_anti").drop("_s", "_d")


def without_orphans(edges: DataFrame, nodes: DataFrame, types: list[str]) -> DataFrame:
    """Edges without those of the given types that have an end which is no node."""
    chosen = F.coalesce(F.col("edge_type").isin(types), F.lit(False))
    return edges.where(~chosen).unionByName(edges_within(edges.where(chosen), _ids(nodes)))


def reassign(nodes: DataFrame, assignment: DataFrame) -> DataFrame:
    """``nodes`` with the branch that ``assignment`` (ingest_seq, new_branch) gives them, else their own."""
    out = nodes.join(assignment.select("ingest_seq", F.col("new_branch").alias("_b")), "ingest_seq", "left")
    return out.withColumn("branch_id", F.coalesce("_b", "branch_id")).drop("_b")
