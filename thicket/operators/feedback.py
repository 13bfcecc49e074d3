"""Feedback on retrieved branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.config import Config
from thicket.functions.vectors import clamp

DAY = 86400.0


def reward(cfg: Config = Config()) -> Column:
    """A given signal, else 1 for used and not corrected, -0.5 for corrected, 0 otherwise."""
    return F.when(F.col("usefulness_signal").isNotNull(), clamp(F.col("usefulness_signal"))).when(F.col("corrected"), -0.5).when(F.col("used"), 1.0).otherwise(0.0)


def usefulness(feedback: DataFrame, start: float = 0.0, cfg: Config = Config(), slice_seconds: float = DAY) -> DataFrame:
    """(branch_id, n, usefulness, retrieval_error): exponential means in order of (timestamp, seq), in closed form.

    The mean after n steps is the start times (1 - l)^n plus the sum of l (1 - l)^(n - j) r_j. Each slice of
    time is summed on its own with powers counted from its end, and the slices of a branch are folded
    by their lengths, so no branch is sorted in one task.
    """
    lam = cfg.feedback_lambda
    rows = feedback.withColumn("_slice", F.floor(F.col("timestamp") / slice_seconds)).withColumn("_r", reward(cfg)).withColumn("_c", F.col("corrected").cast("double"))
    back = Window.partitionBy("branch_id", "_slice").orderBy(F.col("timestamp").desc(), F.col("seq").desc())
    rows = rows.withColumn("_p", F.pow(F.lit(1 - lam), F.row_number().over(back) - 1) * lam)
    per = rows.groupBy("branch_id", "_slice").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_p") * F.col("_r")).alias("u"), F.sum(F.col("_p") * F.col("_c")).alias("e"))
    after = Window.partitionBy("branch_id").orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
    per = per.withColumn("_w", F.pow(F.lit(1 - lam), F.coalesce(F.sum("n").over(after), F.lit(0))))
    out = per.groupBy("branch_id").agg(F.sum("n").alias("n"), F.sum(F.col("u") * F.col("_w")).alias("u"), F.sum(F.col("e") * F.col("_w")).alias("e"))
    decay = F.pow(F.lit(1 - lam), F.col("n"))
    return out.select("branch_id", "n", (F.col("u") + start * decay).alias("usefulness"), (F.col("e") + start * decay).alias("retrieval_error"))


def statistics(feedback: DataFrame) -> DataFrame:
    """Per branch: mean use (the signal where there is one), corrections, expansions."""
    d = lambda c: F.col(c).cast("double")
    return feedback.groupBy("branch_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("usefulness_signal", d("used"))).alias("use_rate"), F.avg(d("corrected")).alias("correction_rate"), F.avg(d("expanded")).alias("expansion_rate"),
    )


def co_use(feedback: DataFrame, lookback: int = Config().couse_lookback) -> DataFrame:
    """(branch_a, branch_b, shared, queries, co_use) of the pairs of branches retrieved for one query.

    Of the rows of both branches only the newest ``lookback`` count, by (timestamp, seq). co_use is the share of queries
    that retrieved both among those that retrieved either, times 0.5 + 0.5 times the mean of how far both were used.

    No branch has more than ``lookback`` rows after the first step, so what is held per branch is bounded; the
    cut of a pair is looked up only where both together have more. A query pairs the branches it retrieved, which
    are as many as a ranking returns at most; its rows are reduced to one for each branch first.
    """
    newest = Window.partitionBy("branch_id").orderBy(F.col("timestamp").desc(), F.col("seq").desc())
    rows = feedback.select("query_id", "branch_id", "timestamp", "seq", F.coalesce(F.col("used").cast("int"), F.lit(0)).alias("used"))
    rows = rows.where("branch_id IS NOT NULL AND query_id IS NOT NULL").withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= lookback)
    at = F.struct(F.col("timestamp").alias("t"), F.col("seq").alias("s"))
    per = rows.groupBy("query_id", "branch_id").agg(F.max(at).alias("last"), F.collect_list(F.struct(at.alias("at"), "used")).alias("hits"))
    held = rows.groupBy("branch_id").agg(F.collect_list(at).alias("all"))
    held = held.join(per.groupBy("branch_id").agg(F.collect_list("last").alias("lasts")), "branch_id")
    side = lambda x: per.select("query_id", F.col("branch_id").alias(f"branch_{x}"), F.col("last").alias(f"last_{x}"), F.col("hits").alias(f"hits_{x}"))
    both = side("a").join(side("b"), "query_id").where("branch_a < branch_b")
    of = lambda x: held.select(F.col("branch_id").alias(f"branch_{x}"), F.col("all").alias(f"all_{x}"), F.col("lasts").alias(f"lasts_{x}"))
    pairs = both.select("branch_a", "branch_b").distinct().join(of("a"), "branch_a").join(of("b"), "branch_b")
    joint = F.sort_array(F.concat("all_a", "all_b"), asc=False)
    pairs = pairs.withColumn("cut", F.when(F.size("all_a") + F.size("all_b") > lookback, F.element_at(joint, lookback)))
    inside = lambda c: F.col("cut").isNull() | (c >= F.col("cut"))
    count = lambda x: F.size(F.filter(f"lasts_{x}", inside))
    pairs = pairs.select("branch_a", "branch_b", "cut", (count("a") + count("b")).alias("n"))
    used = lambda x: F.array_max(F.transform(F.filter(f"hits_{x}", lambda h: inside(h["at"])), lambda h: h["used"]))
    seen = both.join(pairs, ["branch_a", "branch_b"]).where(inside(F.col("last_a")) & inside(F.col("last_b")))
    out = seen.groupBy("branch_a", "branch_b").agg(F.count(F.lit(1)).alias("shared"), F.first("n").alias("n"), F.avg((used("a") + used("b")) / 2).alias("quality"))
    queries = F.col("n") - F.col("shared")
    return out.select("branch_a", "branch_b", "shared", queries.cast("long").alias("queries"), clamp(F.col("shared") / queries * (0.5 + 0.5 * F.col("quality"))).alias("co_use"))


def retained(feedback: DataFrame, now: float, cfg: Config = Config()) -> DataFrame:
    """Rows not older than the limit in days; of those at most the newest ``feedback_rows``.

    The cut is found from counts per hour, so only one hour is sorted.
    """
    young = feedback.where(F.col("timestamp") >= now - cfg.feedback_days * DAY).withColumn("_h", F.floor(F.col("timestamp") / 3600))
    per = young.groupBy("_h").agg(F.count(F.lit(1)).alias("n"))
    newer = F.coalesce(F.sum("n").over(Window.orderBy(F.col("_h").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = F.broadcast(per.withColumn("_newer", newer).where(F.col("_newer") < cfg.feedback_rows))
    rank = F.row_number().over(Window.partitionBy("_h").orderBy(F.col("timestamp").desc(), F.col("seq").desc()))
    return young.join(per, "_h").withColumn("_rk", rank).where(F.col("_newer") + F.col("_rk") <= cfg.feedback_rows).drop("_h", "n", "_newer", "_rk")
