"""Order within branches: what follows what, chains of corrections, latest versions.

A branch may hold a third of all nodes, so its order is never sorted in one task. Each branch is cut into
slices of time (rows without time into slices of their sequence numbers); a slice is sorted on its own, and the slices of a branch are tied together by one small
row each (its last node, its number of rows and of chain starts).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600.0
#: Sequence numbers that a slice of rows without time spans.
UNTIMED = 200_000


def _slice(ts: Column, width: float) -> Column:
    """A number for each slice that grows with (ts, ingest_seq): slices of time, those without time cut by sequence."""
    at = F.greatest(F.least(F.floor(ts / width), F.lit(1 << 40)), F.lit(-(1 << 40)))
    last = (1 << 20) - 1
    return at * F.lit(1 << 20) + F.when(ts == 0, F.least(F.floor(F.col("ingest_seq") / UNTIMED), F.lit(last - 1))).otherwise(F.lit(last))


def ordered(nodes: DataFrame, start: Column | None = None, width: float = HOUR) -> DataFrame:
    """``nodes`` (branch_id, id, timestamp, ingest_seq, ...) with prev_id, rank (from 1) and, where ``start``
    says which rows begin a chain, the number of chains begun so far.

    Order is (timestamp, ingest_seq); a null time sorts first. Nodes without branch are left out.
    """
    ts = F.coalesce("timestamp", F.lit(0.0))
    rows = nodes.where("branch_id IS NOT NULL").withColumn("_slice", _slice(ts, width))
    own = Window.partitionBy("branch_id", "_slice").orderBy(ts, "ingest_seq")
    mark = F.lit(0) if start is None else start.cast("int")
    rows = rows.withColumn("_prev", F.lag("id").over(own)).withColumn("_rank", F.row_number().over(own))
    last = F.max(F.struct(ts.alias("t"), "ingest_seq", "id")).alias("last")
    ends = nodes.where("branch_id IS NOT NULL").withColumn("_slice", _slice(ts, width)).groupBy("branch_id", "_slice").agg(last, F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("branch_id").orderBy("_slice")
    upto = before.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("branch_id", "_slice", F.lag("last.id").over(before).alias("_first_prev"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("_offset"))
    out = rows.join(ends, ["branch_id", "_slice"])
    out = out.withColumn("prev_id", F.coalesce("_prev", "_first_prev")).withColumn("rank", F.col("_offset") + F.col("_rank"))
    if start is None:
        return out.drop("_slice", "_prev", "_rank", "_first_prev", "_offset")
    out = out.withColumn("_mark", (F.col("prev_id").isNull() | mark.cast("boolean")).cast("long")).drop("_first_prev")
    sums = out.groupBy("branch_id", "_slice").agg(F.sum("_mark").alias("_m"))
    sums = sums.select("branch_id", "_slice", F.coalesce(F.sum("_m").over(upto), F.lit(0)).alias("_chains"))
    running = F.sum("_mark").over(own.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_run", running).join(sums, ["branch_id", "_slice"]).withColumn("chain", F.col("_chains") + F.col("_run"))
    return out.drop("_slice", "_prev", "_rank", "_offset", "_mark", "_run", "_chains")


def temporal_edges(nodes: DataFrame) -> DataFrame:
    """(src_id, dst_id) from every node of a branch to the next."""
    o = ordered(nodes.select("branch_id", "id", "timestamp", "ingest_seq"))
    return o.where("prev_id IS NOT NULL").select(F.col("prev_id").alias("src_id"), F.col("id").alias("dst_id"))


def correction_chains(nodes: DataFrame, modes: tuple[str, ...] = ("refine", "contradict", "supersede")) -> DataFrame:
    """(id, kind, prev_id, root_id, version): a correcting node continues the chain of the node before it."""
    links = F.coalesce(F.col("update_mode").isin(list(modes)), F.lit(False))
    o = ordered(nodes.select("branch_id", "id", "timestamp", "ingest_seq", "update_mode"), start=~links)
    heads = o.where(F.col("prev_id").isNull() | ~links).select("branch_id", "chain", F.col("id").alias("root"), F.col("rank").alias("_r0"))
    out = o.join(heads, ["branch_id", "chain"])
    linked = F.col("rank") > F.col("_r0")
    return out.select(
        "id", "ingest_seq", F.when(linked, F.col("update_mode")).otherwise("none").alias("kind"), F.when(linked, F.col("prev_id")).alias("prev_id"),
        F.when(linked, F.col("root")).alias("root_id"), (F.col("rank") - F.col("_r0") + 1).alias("version"),
    )


def latest_versions(nodes: DataFrame) -> DataFrame:
    """Per root of a chain: its length and the latest node by (version, time, sequence)."""
    root = F.coalesce("correction_root_id", "id").alias("root_id")
    best = F.max(F.struct("correction_version", "timestamp", "ingest_seq", "id")).alias("b")
    per = nodes.select(root, "correction_version", "timestamp", "ingest_seq", "id").groupBy("root_id").agg(F.count(F.lit(1)).alias("length"), best)
    return per.where("length > 1").select("root_id", "length", F.col("b.id").alias("latest_id"), F.col("b.correction_version").alias("version"))


def duplicate_map(nodes: DataFrame) -> DataFrame:
    """(id, keep_id): every node of a (branch, source id) but the first, and the first."""
    first = nodes.groupBy("branch_id", "lcm_id").agg(F.min(F.struct("ingest_seq", "id")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    out = nodes.join(first.select("branch_id", "lcm_id", F.col("f.id").alias("keep_id"), F.col("f.ingest_seq").alias("_s")), ["branch_id", "lcm_id"])
    return out.where(F.col("ingest_seq") > F.col("_s")).select("ingest_seq", "id", "keep_id")
