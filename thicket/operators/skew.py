"""Per-key work when a few keys hold most rows: fragment and replicate by load.

``plan_tasks`` measures the load of every key with a partial aggregate (one small row per
key and map task is shuffled, never the rows), splits keys above the load of one task into
shards in proportion to their load, and packs the shards and the hash buckets of the
remaining keys into tasks, largest first. The plan is bounded: at most ``tasks * factor``
keys can be above ``total / (tasks * factor)``, and the light keys appear only as a fixed
number of buckets.

``per_key`` then sends every row to its task, replicates the matching side only to the
shards of a heavy key, aggregates each shard, and combines the shards of a key.

Null keys have no task: they match nothing, as in any equi-join, and are left out; a row
of the matching side without rows on the large side gives no result row. Empty inputs give
empty results. Repeated rows count each.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.session import parallelism

#: Hash buckets that stand for all light keys, for each task.
BUCKETS_PER_TASK = 16
#: A key is heavy above this share of one task's load.
FACTOR = 4


@dataclass
class TaskPlan:
    """tasks: number of tasks; heavy: (key, load, shards); slots: (key or null, shard or bucket, task)."""

    tasks: int
    buckets: int
    total: int
    loads: DataFrame
    heavy: DataFrame
    slots: DataFrame


def loads(df: DataFrame, key: str) -> DataFrame:
    """Rows of each non-null key. Only partial counts cross the network."""
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("load"))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys that hold more than ``share`` of the rows; fewer than ``1 / share`` of them."""
    per = loads(df, key)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return per.join(F.broadcast(total)).where(F.col("load") > F.col("total") * F.lit(share)).drop("total")


def task_labels(spark, tasks: int) -> list[int]:
    """For each task a number whose hash partition of ``tasks`` is that task."""
    found: dict[int, int] = {}
    n = tasks * 16
    while len(found) < tasks:
        ids = spark.range(n).select(F.col("id").cast("int").alias("id"))
        rows = ids.groupBy(F.pmod(F.hash("id"), F.lit(tasks)).alias("t")).agg(F.min("id").alias("id")).collect()
        found = {r["t"]: r["id"] for r in rows}
        n *= 4
    return [found[t] for t in range(tasks)]


def plan_tasks(df: DataFrame, key: str, tasks: int | None = None, largest_share: float = 0.025) -> TaskPlan:
    """Heavy keys with their shards, and the task of every shard and bucket."""
    spark = df.sparkSession
    per = loads(df, key)
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    tasks = tasks or parallelism(spark, total)
    labels = task_labels(spark, tasks)
    n_buckets = tasks * BUCKETS_PER_TASK
    limit = max(1.0, min(total / (tasks * FACTOR), total * largest_share))
    marked = per.withColumn("heavy", F.col("load") > limit)
    # bounded: fewer than total / limit heavy keys, and one row per bucket
    rows = (
        marked.groupBy(
            F.when(F.col("heavy"), F.col("key").cast("string")).alias("key"),
            F.when(~F.col("heavy"), F.pmod(F.xxhash64("key"), F.lit(n_buckets))).cast("int").alias("bucket"),
        )
        .agg(F.sum("load").alias("load"))
        .collect()
    )
    per_task = max(1.0, total / tasks)
    pieces, heavy = [], []
    for r in rows:
        if r["key"] is None:
            pieces.append((r["load"], None, r["bucket"]))
        else:
            shards = max(1, -(-int(r["load"] * FACTOR) // int(per_task)))
            heavy.append((r["key"], int(r["load"]), shards))
            pieces += [(r["load"] / shards, r["key"], s) for s in range(shards)]
    # largest first into the task with the least load
    bins = [(0.0, t) for t in range(tasks)]
    heapq.heapify(bins)
    slots = []
    for load, k, piece in sorted(pieces, key=lambda x: (-x[0], x[1] or "", x[2])):
        filled, t = heapq.heappop(bins)
        slots.append((k, int(piece), labels[t]))
        heapq.heappush(bins, (filled + load, t))
    heavy_df = spark.createDataFrame(heavy, "key string, load long, shards int")
    slots_df = spark.createDataFrame(slots, "_sk string, piece int, task int")
    return TaskPlan(tasks, n_buckets, total, per, heavy_df, slots_df)


def spread(df: DataFrame, key: str, plan: TaskPlan, replicate: bool, row_hash: Column | None = None) -> DataFrame:
    """``df`` with ``_task`` and ``_piece``: rows of a heavy key go to one of its shards by the
    hash of the row, or to all of them when the side is replicated."""
    ktext = F.col(key).cast("string")
    heavy = F.broadcast(plan.heavy.select(F.col("key").alias("_hk"), F.col("shards").alias("_shards")))
    out = df.where(F.col(key).isNotNull()).join(heavy, ktext == F.col("_hk"), "left")
    light = F.pmod(F.xxhash64(key), F.lit(plan.buckets)).cast("int")
    if replicate:
        pieces = F.when(F.col("_hk").isNull(), F.array(light)).otherwise(F.sequence(F.lit(0), F.col("_shards") - 1))
        out = out.withColumn("_piece", F.explode(pieces))
    else:
        row_hash = F.monotonically_increasing_id() if row_hash is None else row_hash
        out = out.withColumn(
            "_piece", F.when(F.col("_hk").isNull(), light).otherwise(F.pmod(row_hash, F.col("_shards").cast("long")).cast("int"))
        )
    slots = F.broadcast(plan.slots.withColumnRenamed("piece", "_p").withColumnRenamed("task", "_task"))
    return out.join(slots, F.col("_hk").eqNullSafe(F.col("_sk")) & (F.col("_piece") == F.col("_p")), "left").drop(
        "_hk", "_shards", "_sk", "_p"
    )


def per_key(
    df: DataFrame,
    key: str,
    partial: dict[str, Column],
    final: dict[str, Column],
    match: DataFrame | None = None,
    match_key: str | None = None,
    plan: TaskPlan | None = None,
    row_hash: Column | None = None,
) -> DataFrame:
    """One row per key. ``partial`` aggregates a shard, ``final`` combines the shards.

    ``match`` is the other side of the join; its columns may be used in ``partial`` and must
    not clash with those of ``df``. Both sides go to the task of their shard in one placement, where the matching
    rows come first in their shard and are handed to the rows behind them; several of one key pair with each.
    """
    plan = plan or plan_tasks(df, key)
    big = spread(df, key, plan, replicate=False, row_hash=row_hash)
    if match is None:
        big = big.repartition(plan.tasks, "_task")
    else:
        lookup = [c for c in match.columns if c != (match_key or key)]
        small = spread(match.withColumnRenamed(match_key or key, key), key, plan, replicate=True)
        small = small.withColumn("_side", F.lit(0)).withColumn("_m", F.struct(*lookup)).drop(*lookup)
        both = big.withColumn("_side", F.lit(1)).unionByName(small, allowMissingColumns=True).repartition(plan.tasks, "_task")
        shard_rows = Window.partitionBy("_task", key, "_piece").orderBy("_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        big = both.withColumn("_m", F.collect_list("_m").over(shard_rows)).where("_side = 1").drop("_side").select("*", F.explode_outer("_m").alias("_e")).select("*", "_e.*").drop("_m", "_e")
    shard = big.groupBy("_task", key, "_piece").agg(*[c.alias(n) for n, c in partial.items()])
    return shard.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def skew_join(left: DataFrame, right: DataFrame, on: str, how: str, heavy: DataFrame, shards: int = 16, row_hash: Column | None = None) -> DataFrame:
    """An equi-join on one column in which the keys of ``heavy`` (a bounded table with a column
    ``key``) are split over ``shards`` on the left and replicated on the right."""
    h = F.broadcast(heavy.select(F.col("key").alias("_hot_key")).distinct())
    row_hash = F.monotonically_increasing_id() if row_hash is None else row_hash
    salt = F.when(F.col("_hot_key").isNotNull(), F.pmod(row_hash, F.lit(shards)).cast("int")).otherwise(F.lit(0))
    copies = F.when(F.col("_hot_key").isNotNull(), F.sequence(F.lit(0), F.lit(shards - 1))).otherwise(F.array(F.lit(0)))
    lhs = left.join(h, F.col(on) == F.col("_hot_key"), "left").withColumn("_salt", salt).drop("_hot_key")
    rhs = right.join(h, F.col(on) == F.col("_hot_key"), "left").withColumn("_salt", F.explode(copies)).drop("_hot_key")
    return lhs.join(rhs, [on, "_salt"], how).drop("_salt")


def dominant(df: DataFrame, key: str, share: float = 0.025) -> DataFrame:
    """(key, load): keys above ``share`` of all rows, null keys counted in the total.

    The rows of every key are counted as any result per key is: in the tasks their shards are packed into, and
    combined from the shards.
    """
    plan = plan_tasks(df, key, largest_share=share)
    counted = per_key(df, key, partial={"n": F.count(F.lit(1))}, final={"load": F.sum("n")}, plan=plan)
    return counted.where(F.col("load") > F.lit(plan.total) * F.lit(share)).select(F.col(key).cast("string").alias("key"), "load")
