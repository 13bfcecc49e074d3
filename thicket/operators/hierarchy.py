"""Parent-child links to full hierarchies by tree contraction.

Each round rakes the leaves and splices nodes out of unary chains (those whose random priority
is lower than that of their parent and of their only child, so no two neighbours go at once).
Every removal is recorded with the node it now hangs on, the hops between them, the nodes below it and, where
paths are wanted, the nodes in between. What is left when nothing can be removed any more
is a set of nodes that point at themselves: the cores of circles. The recorded removals are
then reversed, latest first, and hand down root, depth, path, the number of descendants and whether a node lies on a
circle. A forest of any depth ``d`` needs a number of rounds in the order of ``log d``, each over
a fraction of the rows of the one before; every round is a written table. When few links are left, one task resolves
them all, which gives the same result in fewer rounds.

A node whose parent is null or has no row is a root (``end`` tells which: ``root`` or
``dangling``). A node naming itself is a circle of one. A node leading into a circle has no root;
its depth and path are counted from the core of that circle and ``end`` is ``cycle``. Several
rows with one key are one node, the first by sequence. Null keys are left out. Empty
input gives empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from thicket.operators.skew import heavy_keys, skew_join
from thicket.session import Scratch


def number_nodes(rows: DataFrame, links: list[str], extra: list[str] = (), seq: str = "seq") -> DataFrame:
    """One row per key: ``nid`` (the lowest sequence number of its rows), its stored id and links.

    ``rows`` has key, id, seq, the link columns and the extra ones.
    """
    cols = ["id", *links, *extra]
    first = rows.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(F.col(seq).alias("nid"), *cols)).alias("r"))
    return first.select("key", "r.*")


def link_edges(nodes: DataFrame, link: str) -> DataFrame:
    """(nid, pid, dangling) for every node; pid is null for a root."""
    names = nodes.select(F.col("key").alias("_k"), F.col("nid").alias("pid"))
    child = nodes.select("nid", F.col(link).alias("_k"))
    # a root asks with its own number, so that roots do not meet in one task; no key is a bare number
    asked = child.select("nid", F.coalesce("_k", F.concat(F.lit("\x00"), F.col("nid").cast("string"))).alias("_a"), "_k")
    out = skew_join(asked, names.withColumnRenamed("_k", "_a"), "_a", "left", heavy_keys(child, "_k", 0.005), row_hash=F.col("nid"))
    return out.select("nid", "pid", (F.col("_k").isNotNull() & F.col("pid").isNull()).alias("dangling"))


#: Alive links that one task may resolve at the end: some MB.
FINISH = 20_000
#: A parent with at least so many children, and half a percent of all rows, is split in the joins.
HOT = 50_000

_KNOWN = "nid long, root long, depth long, end string, on_cycle boolean, size long, path array<long>"


def contract(edges: DataFrame, with_paths: bool = False, max_rounds: int = 200, finish: int = FINISH) -> DataFrame:
    """(nid, root, depth, end, on_cycle, size[, path]) from (nid, pid, dangling); numbers are not negative.

    size counts the node and all its descendants; every node of a circle has the whole circle and what hangs below it.
    path is the array of nids from the root (or the core of the circle) to the node; all paths of a chain of d nodes
    are d * d / 2 numbers, so they are only made where asked for.

    A link (c, p, w, x, acc) leads over w hops to p, past spliced nodes that have x nodes in and below them but not below
    c; acc counts c and what was raked off it. A root has a link to a negative number of its own.
    What a round rakes is added to its parent in the next round. At most ``finish`` links are resolved by one task.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "hierarchy")
    long = lambda v: F.lit(v).cast("long")
    seg = F.array().cast("array<long>") if with_paths else F.lit(None).cast("array<long>")
    top = -1 - 2 * F.col("nid") - F.col("dangling").cast("long")
    alive = edges.select(F.col("nid").alias("c"), F.coalesce("pid", top).alias("p"), F.col("pid").isNotNull().cast("long").alias("w"), long(0).alias("x"), long(1).alias("acc"), seg.alias("seg"))
    alive = scratch.save(alive, "alive")
    count = alive.count()
    # at most 200 parents have half a percent of the rows; none ever gets more children than it had
    heavy = heavy_keys(alive.where("p >= 0"), "p", 0.005).where(F.col("load") >= HOT)
    hot = [r["key"] for r in heavy.select("key").collect()] if count >= HOT else []
    path = lambda *a: F.array(*a) if with_paths else F.lit(None).cast("array<long>")
    rounds: list[DataFrame] = []
    pending = None  # (p, g) raked in the last round and not yet added
    known = None

    def settle(done: DataFrame) -> DataFrame:
        """The finished rows of a round: roots without children, and cores of circles."""
        end = F.when(F.col("act") == "core", "cycle").when(F.pmod("p", F.lit(2)) == 0, "dangling").otherwise("root")
        circle = F.col("act") == "core"
        size = F.col("acc") + F.when(circle, F.col("x")).otherwise(0)
        return done.select(F.col("c").alias("nid"), F.when(~circle, F.col("c")).alias("root"), long(0).alias("depth"), end.alias("end"), circle.alias("on_cycle"), size.alias("size"), path("c").alias("path"))

    for turn in range(max_rounds):
        if rounds and count <= finish:
            break
        seen = Observation()
        left = F.sum((F.col("act") == "keep").cast("long")).alias("left")
        tagged = scratch.save(_one_round(alive, pending, turn, hot, with_paths).observe(seen, left), "round")
        known = scratch.append(settle(tagged.where("act IN ('top', 'core')")), "done")
        if not rounds:
            scratch.drop(alive)
        rounds.append(tagged)
        alive = tagged.where("act = 'keep'").select("c", "p", "w", "x", "acc", "seg")
        pending = tagged.where("act = 'rake'").select("p", (F.col("acc") + F.col("x")).alias("g"))
        count = seen.get["left"] or 0
        if not count:
            break
    else:
        raise RuntimeError("the contraction did not end")
    if count:
        last = _with_pending(alive, pending)
        known = scratch.append(last.coalesce(1).mapInPandas(_finishing(with_paths), _KNOWN), "done")
    for tagged in reversed(rounds):
        raked = tagged.where("act = 'rake'").select("c", "p", "w", F.col("acc").alias("own"), long(None).alias("child"), "seg")
        spliced = tagged.where("s_c IS NOT NULL").select(F.col("s_c").alias("c"), "p", F.col("s_w").alias("w"), F.col("s_own").alias("own"), F.when(F.col("act") != "rake", F.col("c")).alias("child"), F.col("s_seg").alias("seg"))
        gone = raked.unionByName(spliced)
        up = known.select(F.col("nid").alias("p"), "root", "depth", "end", F.col("path").alias("_path"))
        new = _split_join(gone, up, "p", "inner", hot).select(
            F.col("c").alias("nid"), "root", (F.col("depth") + F.col("w")).alias("depth"), "end", "own",
            (F.concat("_path", F.col("seg"), F.array("c")) if with_paths else F.lit(None).cast("array<long>")).alias("path"),
            # a node without child asks a number nobody has
            F.coalesce("child", -1 - F.col("c")).alias("child"),
        )
        # a spliced node lies on a circle if its only child does, which outlived that round and is known by now
        below = known.select(F.col("nid").alias("child"), F.col("on_cycle").alias("_cc"), F.col("size").alias("_cs"))
        asked = new.join(below.hint("merge"), "child", "left")
        size = F.when(F.coalesce("_cc", F.lit(False)), F.col("_cs")).otherwise(F.col("own") + F.coalesce("_cs", F.lit(0)))
        out = asked.select("nid", "root", "depth", "end", F.coalesce("_cc", F.lit(False)).alias("on_cycle"), size.alias("size"), "path")
        known = scratch.append(out, "done")
    return known if with_paths else known.drop("path")


def _split_join(left: DataFrame, right: DataFrame, on: str, how: str, hot: list[int]) -> DataFrame:
    """A merge join in which the rows of a hot number on the left are dealt to 16 tasks."""
    if not hot:
        return left.join(right.hint("merge"), on, how)
    is_hot = F.col(on).isin(hot)
    lhs = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64("c"), F.lit(16)).cast("int")).otherwise(F.lit(0)))
    rhs = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(15))).otherwise(F.array(F.lit(0)))))
    return lhs.join(rhs.hint("merge"), [on, "_salt"], how).drop("_salt")


def _with_pending(alive: DataFrame, pending: DataFrame | None) -> DataFrame:
    """``alive`` with what was raked off each node added to it."""
    if pending is None:
        return alive
    got = pending.where("p >= 0").groupBy("p").agg(F.sum("g").alias("g")).select(F.col("p").alias("c"), "g")
    return alive.join(got.hint("merge"), "c", "left").select("c", "p", "w", "x", (F.col("acc") + F.coalesce("g", F.lit(0))).alias("acc"), "seg")


def _one_round(alive: DataFrame, pending: DataFrame | None, turn: int, hot: list[int], with_paths: bool) -> DataFrame:
    """Every alive link with what becomes of its node this round (act) and, where it now leads past a spliced parent,
    what is recorded of that one (s_c, s_w, s_own, s_seg).

    A round is three exchanges: children counted by parent, the counts sent to their nodes, the spliced ones sent to
    their children. Which of two neighbours in a chain goes is told by random priorities that every node can
    work out for itself. Joins are merge joins in every round: tables that shrink would otherwise be broadcast by
    the driver, a new one and new generated code for each round.
    """
    rank = lambda c: F.xxhash64(F.col(c), F.lit(turn))
    links = alive.where("p >= 0").select("p", "c", F.lit(None).cast("long").alias("g"))
    if pending is not None:
        links = links.unionByName(pending.where("p >= 0").select("p", F.lit(None).cast("long").alias("c"), "g"))
    kids = links.groupBy("p").agg(F.count("c").alias("k"), F.min("c").alias("u"), F.sum("g").alias("g"))
    t = alive.join(kids.withColumnRenamed("p", "c").hint("merge"), "c", "left")
    k, loop = F.coalesce("k", F.lit(0)), F.col("c") == F.col("p")
    chain = (k == 1) & (F.col("p") >= 0) & ~loop & (F.col("u") != F.col("c"))
    wins = (rank("c") < rank("p")) & (rank("c") < rank("u"))
    act = F.when(loop & (k == 1), "core").when((k == 0) & (F.col("p") < 0), "top").when(k == 0, "rake").when(chain & wins, "splice").otherwise("keep")
    t = t.select("c", "p", "w", "x", (F.col("acc") + F.coalesce("g", F.lit(0))).alias("acc"), "seg", act.alias("act"))
    gone = t.where("act = 'splice'").select(F.col("c").alias("p"), F.col("p").alias("_p"), F.col("w").alias("_w"), F.col("x").alias("_x"), F.col("acc").alias("_acc"), F.col("seg").alias("_seg"))
    t = _split_join(t.where("act <> 'splice'"), gone, "p", "left", hot)
    past = F.col("_p").isNotNull()
    none = F.lit(None).cast("array<long>")
    own = F.col("_acc") + F.col("x") + F.when(F.col("act") == "rake", F.col("acc")).otherwise(0)
    return t.select(
        "c", F.coalesce("_p", "p").alias("p"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"),
        (F.col("x") + F.when(past, F.col("_acc") + F.col("_x")).otherwise(0)).alias("x"), "acc",
        (F.when(past, F.concat("_seg", F.array("p"), "seg")).otherwise(F.col("seg")) if with_paths else none).alias("seg"), "act",
        F.when(past, F.col("p")).alias("s_c"), F.col("_w").alias("s_w"), F.when(past, own).alias("s_own"), F.col("_seg").alias("s_seg"),
    )


def _finishing(with_paths: bool):
    """The last links, all in one task: what ``contract`` returns of their nodes."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        c, p, w, x, acc = (pdf[n].to_numpy(np.int64).tolist() for n in ("c", "p", "w", "x", "acc"))
        seg = pdf["seg"].tolist() if with_paths else None
        place = {v: i for i, v in enumerate(c)}
        up = [place[v] if v >= 0 else -1 for v in p]
        kids = [0] * len(c)
        for u in up:
            if u >= 0:
                kids[u] += 1
        size, order = list(acc), [i for i, n in enumerate(kids) if not n]
        for i in order:  # grows while it is gone through: a node follows when its last child is done
            u = up[i]
            if u >= 0:
                size[u] += size[i] + x[i]
                kids[u] -= 1
                if not kids[u]:
                    order.append(u)
        inside = set(order)
        out: list = [None] * len(c)
        for i in range(len(c)):  # what is left lies on circles
            if i in inside or out[i] is not None:
                continue
            ring, j = [], i
            while not ring or j != i:
                ring.append(j)
                j = up[j]
            first = min(range(len(ring)), key=lambda n: c[ring[n]])
            ring = ring[first:] + ring[:first]
            total = sum(size[j] + x[j] for j in ring)
            core, before, deep = ring[0], [c[ring[0]]], 0
            out[core] = (c[core], None, 0, "cycle", True, total, before if with_paths else None)
            for j in reversed(ring[1:]):
                deep += w[j]
                if with_paths:
                    before = [*before, *seg[j], c[j]]
                out[j] = (c[j], None, deep, "cycle", True, total, before if with_paths else None)
        for i in reversed(order):
            if up[i] < 0:
                out[i] = (c[i], c[i], 0, "dangling" if p[i] % 2 == 0 else "root", False, size[i], [c[i]] if with_paths else None)
            else:
                a = out[up[i]]
                out[i] = (c[i], a[1], a[2] + w[i], a[3], False, size[i], [*a[6], *seg[i], c[i]] if with_paths else None)
        yield pd.DataFrame(out, columns=["nid", "root", "depth", "end", "on_cycle", "size", "path"]).astype({"root": "Int64"})

    return f


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, nid, distance): every node below every node, from the paths.

    With on_cycle (and any columns that tell forests apart, such as correction) circles are whole: whoever is on a
    circle or hangs below it is below every other member, at the hops along the links.
    """
    far = F.size("path") - 1
    if "on_cycle" not in paths.columns:
        out = paths.select("nid", far.alias("_n"), F.posexplode("path").alias("_i", "ancestor"))
        return out.where(F.col("_i") < F.col("_n")).select("ancestor", "nid", (F.col("_n") - F.col("_i")).alias("distance"))
    keys = [c for c in paths.columns if c not in ("nid", "path", "on_cycle")]
    # the core comes first in the path of each node of its circle; the members follow in the order of their depth
    core = F.element_at("path", 1)
    members = paths.where("on_cycle").select(*keys, core.alias("_core"), F.col("nid").alias("_m"), far.alias("_q"))
    circles = members.groupBy(*keys, "_core").agg(F.sort_array(F.collect_list(F.struct("_q", "_m"))).alias("_s"))
    circles = circles.select(*keys, "_core", F.transform("_s", lambda m: m["_m"]).alias("_circle"))
    t = paths.withColumn("_core", core).join(circles, [*keys, "_core"], "left").withColumn("_n", far)
    plain = t.select(*keys, "nid", "_n", "_circle", F.posexplode("path").alias("_i", "ancestor")).where(F.col("_i") < F.col("_n"))
    plain = plain.where(F.col("_circle").isNull() | ~F.array_contains(F.slice("_circle", F.col("_i") + 1, 1), F.col("ancestor")))
    plain = plain.select(*keys, "ancestor", "nid", (F.col("_n") - F.col("_i")).alias("distance"))
    # the path shares its first members with the circle up to the place where the node enters it
    size = F.size("_circle")
    shared = F.size(F.filter(F.zip_with(F.slice("path", 1, F.least(F.size("path"), size)), F.slice("_circle", 1, F.least(F.size("path"), size)), lambda p, m: p == m), lambda same: same))
    around = t.where("_circle IS NOT NULL").withColumn("_p", shared - 1).select(*keys, "nid", "_n", "_p", size.alias("_l"), F.posexplode("_circle").alias("_q", "ancestor"))
    hops = F.col("_n") - F.col("_p") + F.pmod(F.col("_p") - F.col("_q"), F.col("_l"))
    around = around.where(F.col("ancestor") != F.col("nid")).select(*keys, "ancestor", "nid", hops.alias("distance"))
    return plain.unionByName(around)
