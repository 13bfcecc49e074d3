"""History taken into the memory conversation by conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.lineage import ordered


def status(conversations: DataFrame, messages: DataFrame, have: DataFrame, per_conversation: int = 200, resume: bool = True) -> DataFrame:
    """(conversation_id, status, messages, taken): skipped_resume if the branch is there already, skipped_empty
    without messages, else processed."""
    n = messages.groupBy("conversation_id").agg(F.count(F.lit(1)).alias("messages"))
    there = have.select("branch_id").distinct().withColumn("there", F.lit(resume))
    c = conversations.select("conversation_id").withColumn("branch_id", F.concat(F.lit("conv_"), F.col("conversation_id").cast("string")))
    j = c.join(there, "branch_id", "left").join(n, "conversation_id", "left")
    skipped, count = F.coalesce("there", F.lit(False)), F.coalesce("messages", F.lit(0))
    label = F.when(skipped, "skipped_resume").when(count == 0, "skipped_empty").otherwise("processed")
    return j.select("conversation_id", label.alias("status"), count.alias("messages"), F.when(skipped, F.lit(0)).otherwise(F.least(count, F.lit(per_conversation))).alias("taken"))


def stride_sample(messages: DataFrame, group: str, size: int) -> DataFrame:
    """At most ``size`` messages of each group: those at places floor(j n / size) in order of time.

    The order comes from slices of time, so a conversation of any length is sampled in parallel.
    """
    rows = messages.select(F.col(group).cast("string").alias("branch_id"), F.col(group).alias("_g"), F.col("ingest_seq").cast("string").alias("id"), F.col("created_at").alias("timestamp"), "ingest_seq")
    o = ordered(rows)
    n = rows.where("branch_id IS NOT NULL").groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"))
    r = F.col("rank") - 1
    j = F.ceil(r * size / F.col("n")).cast("long")
    hit = (F.col("n") <= size) | ((j < size) & (F.floor(j * F.col("n") / size) == r))
    place = F.when(F.col("n") <= size, r).otherwise(j)
    return o.join(n, "branch_id").where(hit).select(F.col("_g").alias(group), "ingest_seq", place.alias("place"))


def ends_and_stride(messages: DataFrame, group: str, size: int) -> DataFrame:
    """At most ``size`` messages of each group: the first, the last, and those at places floor(j n / size) for the j between;
    all of a group that has no more."""
    rows = messages.select(F.col(group).cast("string").alias("branch_id"), F.col(group).alias("_g"), F.col("ingest_seq").cast("string").alias("id"), F.col("created_at").alias("timestamp"), "ingest_seq")
    n = rows.where("branch_id IS NOT NULL").groupBy("branch_id").agg(F.count(F.lit(1)).alias("n"))
    r, keep = F.col("rank") - 1, max(2, size)
    step = F.col("n") / F.lit(float(keep))
    # the place is taken if one of the numbers around r / step leads to it
    near = [F.floor(r / step) + d for d in (0, 1)]
    taken = F.lit(False)
    for j in near:
        taken = taken | ((j >= 1) & (j <= keep - 2) & (F.floor(j * step) == r))
    hit = (F.col("n") <= size) | (r == 0) | (r == F.col("n") - 1) | taken
    return ordered(rows).join(n, "branch_id").where(hit).select(F.col("_g").alias(group), "ingest_seq")
