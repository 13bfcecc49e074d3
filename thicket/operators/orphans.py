"""References to records that do not exist, directly or by way of an orphaned parent.

``live`` decides which records exist: a table has a row for the key, and either the key was
never purged or a row's own time is later than its (last) purge. ``direct`` returns the
references whose record does not exist. Keys are reduced to distinct ones before they are
compared, so a key referred to by a third of all rows costs one row; only missing keys go
back to the rows, and those with many rows are split (``skew_join``).

``cascade`` follows the foreign keys down: the children of an orphaned record are orphans by
inheritance, their children too, and so on. The fixpoint runs as semi-joins in which the
pointer of every unresolved record is squared each round, so records ``d`` levels below an
orphan are reached in ``log2(d)`` rounds; it ends when a round finds no further orphan. A
record on a circle of links is an orphan if any record it leads to is. ``fixpoint`` does so along several foreign
keys at once.

Null and blank references refer to nothing and are no orphans. Repeated rows count each.
A null time of a row is never later than a purge. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.keys import key
from thicket.operators.skew import heavy_keys, skew_join
from thicket.session import Scratch


def live(records: DataFrame, key_col: str, ts_col: str | None, purges: DataFrame | None = None, table: str | None = None) -> DataFrame:
    """(key) of the records that exist."""
    k = records.select(key(key_col).alias("key"), (F.col(ts_col) if ts_col else F.lit(None).cast("double")).alias("ts"))
    k = k.where("key IS NOT NULL").groupBy("key").agg(F.max("ts").alias("ts"))
    if purges is None:
        return k.select("key")
    gone = purges.where(F.lower(F.trim("record_table")) == table).select(key("record_key").alias("key"), "purged_ts")
    gone = gone.where("key IS NOT NULL").groupBy("key").agg(F.max("purged_ts").alias("purged_ts"), F.lit(True).alias("purged"))
    joined = k.join(gone, "key", "left")
    return joined.where(F.col("purged").isNull() | F.coalesce(F.col("ts") > F.col("purged_ts"), F.lit(False))).select("key")


def direct(refs: DataFrame, records: DataFrame) -> DataFrame:
    """Rows of ``refs`` (target, key, ...) without a row (target, key) in ``records``.

    target names the kind of record; both sides are compared by one text column.
    """
    joint = lambda df: F.concat_ws(":", df["target"], df["key"])
    refs = refs.where("key IS NOT NULL").withColumn("_ref", joint(refs))
    counted = refs.groupBy("_ref").agg(F.count(F.lit(1)).alias("n"))
    known = records.select(joint(records).alias("_ref"))
    missing = Scratch(refs.sparkSession, "orphans").save(counted.join(known, "_ref", "left_anti"), "missing")
    total = missing.agg(F.sum("n").alias("t"))
    heavy = missing.join(F.broadcast(total)).where(F.col("n") > F.greatest(F.lit(1000), F.col("t") / 200))
    out = skew_join(refs, missing.select("_ref"), "_ref", "left_semi", heavy.select(F.col("_ref").alias("key")))
    return out.select([c for c in refs.columns if c != "_ref"])


#: From so many open records on, keys that many of them point to are split.
HOT = 50_000


def cascade(records: DataFrame, orphaned: DataFrame, parent: str = "parent", key_name: str = "key") -> DataFrame:
    """(key, levels): records with an orphan at or above them; levels 0 is the orphan itself,
    else the distance to the nearest one.

    ``records`` has one row per key with the key of its parent; ``orphaned`` has the orphaned keys, which need not be
    among them.
    """
    scratch = Scratch(records.sparkSession, "cascade")
    own = orphaned.select(F.col(key_name).alias("key")).distinct().withColumn("levels", F.lit(0).cast("long"))
    nodes = records.select(F.col(key_name).alias("key"), F.col(parent).alias("up"))
    nodes = nodes.join(own, "key", "full").withColumn("hop", F.lit(1).cast("long"))
    # a sound record without parent can neither inherit nor hand down anything
    nodes = scratch.save(nodes.where("levels IS NOT NULL OR up IS NOT NULL"), "round")
    size = F.count("levels").alias("found"), F.count(F.when(F.col("levels").isNull(), 1)).alias("open")
    now = nodes.agg(*size).first()
    while now["found"] and now["open"]:
        # only unresolved records with a record above them look further up
        open_ = nodes.where("levels IS NULL")
        above = nodes.select(F.col("key").alias("up"), F.col("levels").alias("_l"), F.col("up").alias("_up"), F.col("hop").alias("_h"))
        if now["open"] >= HOT:
            joined = skew_join(open_, above, "up", "left", heavy_keys(open_, "up", 0.005).where(F.col("load") >= HOT), row_hash=F.xxhash64("key"))
        else:
            joined = open_.join(above, "up", "left")
        moved = joined.select(
            "key",
            F.when(F.col("_l").isNull(), F.col("_up")).alias("up"),
            (F.col("hop") + F.col("_l")).alias("levels"),
            (F.col("hop") + F.coalesce("_h", F.lit(0))).alias("hop"),
        )
        fresh = scratch.save(nodes.where("levels IS NOT NULL").unionByName(moved.where("levels IS NOT NULL OR up IS NOT NULL")), "round")
        scratch.drop(nodes)
        before, now, nodes = now, fresh.agg(*size).first(), fresh
        if now["found"] == before["found"]:
            break
    return nodes.where("levels IS NOT NULL").select("key", "levels")


def fixpoint(orphaned: DataFrame, links: dict[str, DataFrame], rounds: int = 100) -> DataFrame:
    """(key, via): every record with an orphan above it along any of the foreign keys; via is the key it inherited by, or
    ``direct`` for the orphans themselves.

    ``links`` has (key, parent) rows for each foreign key, a row for each record that has one. Each key is followed to its
    end (``cascade``) from all orphans known so far, in turn, until a whole turn finds none that is new.
    """
    scratch = Scratch(orphaned.sparkSession, "fixpoint")
    known = scratch.save(orphaned.select("key").where("key IS NOT NULL").distinct().withColumn("via", F.lit("direct")), "known")
    n = {name: -1 for name in links}
    for _ in range(rounds):
        before = dict(n)
        for name, link in links.items():
            count = known.count()
            if n[name] == count:
                continue  # nothing new since this key was followed last
            found = cascade(link, known).select("key").join(known, "key", "left_anti")
            known = scratch.save(known.unionByName(found.withColumn("via", F.lit(name))), "known")
            n[name] = known.count()
        if n == before:
            return known
    raise RuntimeError("the cascade did not end")


def report(orphans: DataFrame, ts: Column) -> DataFrame:
    """Orphans per table, field, kind and month of the referring row."""
    month = F.coalesce(F.date_format(F.timestamp_seconds(ts), "yyyy-MM"), F.lit("unknown"))
    return orphans.groupBy("ref_table", "ref_field", "kind", month.alias("month")).agg(F.count(F.lit(1)).alias("orphans"))
