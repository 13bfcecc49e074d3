"""Items laid into containers of fixed capacity.

Harmonic packing: the sizes are parted into classes by the reciprocal of their share of the
capacity (class k holds sizes in (capacity / (k+1), capacity / k], of which exactly k fit), each
parted further into steps of a small fraction of the capacity. A container begins with the fixed number
of items of the largest class at hand, and the room that this leaves, known from the class alone, takes
fixed numbers of items of smaller classes. A pattern (how many of each class) is used for as many
containers as the counts allow, so the whole plan follows from one histogram of bounded length, and
is shorter than twice the number of classes.

``pure`` is the plain form: each class fills containers of its own with its fixed count, whatever room that leaves.

An item's container then follows from its class and its number within the class alone; every
worker fills containers independently of all others.

An item larger than the capacity is cut into pieces of exactly the capacity and a rest; no other item
is cut. Items of size null or below 1 take no room and are left out. Repeated rows are items
each. Empty input gives no containers. Columns of the input that clash with the output are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators.ranking import bucketed_rank
from thicket.session import Scratch

#: Steps into which the capacity is divided at most.
STEPS = 512
#: Items that one task numbers at most, about.
BUCKET_ITEMS = 500_000


def pieces(sizes: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, capacity, doc_id, piece, token_start, tokens) of every item for every capacity.

    ``profiles`` is a short list of capacities (one row each), which becomes a constant.
    """
    caps = profiles.select("profile", F.col("capacity_tokens").cast("long").alias("c")).where("c > 0").distinct().collect()
    each = F.array(*[F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["c"]).cast("long").alias("capacity")) for r in caps])
    items = sizes.select("doc_id", F.col("tokens").cast("long").alias("size")).where("size > 0")
    items = items.select("*", F.inline(each)) if caps else items.select("*", F.lit("").alias("profile"), F.lit(1).cast("long").alias("capacity")).limit(0)
    cut = items.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(size - 1) div capacity"))))
    start = F.col("piece") * F.col("capacity")
    return cut.select("profile", "capacity", "doc_id", "piece", start.alias("token_start"), F.least(F.col("capacity"), F.col("size") - start).alias("tokens"))


def size_class(steps: int = STEPS):
    """Class of a piece: step of its size, told apart where a reciprocal of the capacity lies between."""
    width = F.ceil(F.col("capacity") / F.lit(steps))
    return F.struct(F.expr("capacity div tokens").alias("k"), F.ceil(F.col("tokens") / width).cast("long").alias("step"))


def plan(histogram: list[tuple[int, int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Patterns from (class, largest size, count) of one capacity.

    Returns (class, first number, last number + 1, items a container, first container) and the
    number of containers.
    """
    classes = sorted(histogram, key=lambda c: (-c[1], c[0]))
    left = [c[2] for c in classes]
    at = [0] * len(classes)
    out, containers, i = [], 0, 0
    while i < len(classes):
        if not left[i]:
            i += 1
            continue
        most = min(left[i], capacity // classes[i][1])
        # as many of the largest class as fit, unless beginning with fewer leaves clearly less room:
        # small items are worth more where they are needed
        tries = [_fill(classes, left, i, m, capacity) for m in sorted({*range(max(1, most - 2), most + 1), 1}, reverse=True)]
        used = min(enumerate(tries), key=lambda t: t[1][0] + (t[0] > 0) * capacity / 20)[1][1]
        times = min(left[j] // m for j, m in used)
        for j, m in used:
            out.append((classes[j][0], at[j], at[j] + m * times, m, containers))
            at[j] += m * times
            left[j] -= m * times
        containers += times
    return out, containers


def _fill(classes: list[tuple[int, int, int]], left: list[int], i: int, m: int, capacity: int) -> tuple[int, list[tuple[int, int]]]:
    """Room left and (place of the class, number of items) of a container that begins with m of class i."""
    free, used = capacity - m * classes[i][1], [(i, m)]
    for j in range(i + 1, len(classes)):
        if not free:
            break
        size = classes[j][1]
        if left[j] and size <= free:
            n = min(left[j], free // size)
            used.append((j, n))
            free -= n * size
    return free, used


def plan_pure(histogram: list[tuple[int, int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """The plain harmonic plan, as ``plan`` returns it: class k (whose sizes are above capacity / (k + 1) and at most
    capacity / k) fills containers with k items each. The classes are numbered by k."""
    out, containers = [], 0
    for k, _, n in sorted(histogram):
        out.append((k, 0, n, k, containers))
        containers += -(-n // k)
    return out, containers


def pack(sizes: DataFrame, profiles: DataFrame, steps: int = STEPS, pure: bool = False) -> DataFrame:
    """(profile, container_id, doc_id, piece, token_start, tokens); container ids count from 0 per profile."""
    spark = sizes.sparkSession
    cls = F.expr("capacity div tokens") if pure else F.col("_c.step") * F.lit(1 << 32) + F.col("_c.k")
    items = pieces(sizes, profiles).withColumn("_c", size_class(steps)).withColumn("class", cls).drop("_c")
    items = Scratch(spark, "packing").save(items, "items")
    # bounded: at most two classes for each step of each capacity, or twice the root of the capacity
    counted = items.groupBy("profile", "capacity", "class").agg(F.max("tokens").alias("largest"), F.count(F.lit(1)).alias("n")).collect()
    slots = []
    for profile, capacity in sorted({(r["profile"], r["capacity"]) for r in counted}, key=str):
        hist = [(r["class"], r["largest"], r["n"]) for r in counted if (r["profile"], r["capacity"]) == (profile, capacity)]
        by_class: dict[int, list] = {}
        for cls, lo, _, m, base in (plan_pure if pure else plan)(hist, capacity)[0]:
            by_class.setdefault(cls, []).append((lo, m, base))
        slots += [(profile, cls, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for cls, v in by_class.items()]
    alloc = spark.createDataFrame(slots, "profile string, class long, lo array<long>, m array<long>, base array<long>")
    numbered = bucketed_rank(items, ["profile", "class"], ["doc_id", "piece"], buckets=max(256, sum(r["n"] for r in counted) // BUCKET_ITEMS), name="number")
    found = numbered.join(F.broadcast(alloc), ["profile", "class"])
    # the last range that begins at or before the number
    k = F.size(F.filter("lo", lambda x: x <= F.col("number")))
    lo, m, base = (F.element_at(c, k) for c in ("lo", "m", "base"))
    container = base + F.floor((F.col("number") - lo) / m)
    return found.select("profile", container.cast("long").alias("container_id"), "doc_id", "piece", "token_start", "tokens")


def report(packed: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per profile: containers, tokens, share of room unused, and the containers that would do without any."""
    p = F.broadcast(profiles.select("profile", F.col("capacity_tokens").cast("long").alias("capacity")))
    per = packed.groupBy("profile", "container_id").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("n"))
    total = per.groupBy("profile").agg(F.count(F.lit(1)).alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), F.sum("n").alias("items"))
    room = F.col("containers") * F.col("capacity")
    return total.join(p, "profile").select(
        "profile", "capacity", "containers", "items", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        (1 - F.col("tokens") / room).alias("unused_share"),
    )
