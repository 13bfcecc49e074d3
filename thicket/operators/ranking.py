"""Ranks and running positions without a global sort or an unbounded window.

``bucketed_rank`` numbers the rows of each group from 0. Rows are dealt to hash buckets; the
buckets of a group are counted and offset, and only a bucket is ever sorted in one task. A group
that holds a third of all rows is thus numbered by as many tasks as there are buckets.

``tie_rank`` ranks keys by a count: the rank is the number of keys with at least that count, so ties
share one. Only the distinct counts of a group are sorted, which are few (values up to n add
up to the total, so there are at most about the square root of twice the total).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.skew import skew_join


def bucketed_rank(df: DataFrame, group: list[str], order: list[str], buckets: int = 256, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: 0 ... n-1 within each group. Rows equal in ``order`` are numbered in any order.

    Null group values form a group of their own. An empty table stays empty.
    """
    b = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_b").alias("_ob"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy(*group, "_b").orderBy(*order)
    numbered = b.withColumn("_rn", F.row_number().over(within))
    on = F.col("_b") == F.col("_ob")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    out = numbered.join(offsets, on).withColumn(name, F.col("_off") + F.col("_rn") - 1)
    return out.select(*df.columns, name)


def tie_rank(df: DataFrame, group: list[str], count: str, name: str = "rank") -> DataFrame:
    """``df`` with ``name``: the number of rows of the group whose count is at least this one's."""
    per = df.groupBy(*group, count).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*group).orderBy(F.col(count).desc()).rowsBetween(Window.unboundedPreceding, 0)
    of = F.xxhash64(*group, count).alias("_of")
    # most keys have the lowest counts: fewer than 200 counts have half a percent of all keys each, and those are split
    total = F.broadcast(per.agg(F.sum("_n").alias("_t")))
    heavy = per.join(total).where(F.col("_n") > F.greatest(F.lit(1000), F.col("_t") / 200)).select(of.alias("key"))
    ranks = per.withColumn(name, F.sum("_n").over(upto)).select(of, *[F.col(g).alias(f"_g{i}") for i, g in enumerate([*group, count])], name)
    out = skew_join(df.withColumn("_of", of), ranks, "_of", "inner", heavy)
    for i, g in enumerate([*group, count]):
        out = out.where(F.col(g).eqNullSafe(F.col(f"_g{i}")))
    return out.select(*df.columns, name)
