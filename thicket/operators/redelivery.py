"""Messages delivered more than once: one copy of each identifier stays.

A Bloom filter for every time bucket screens identifiers that were delivered once; only the
rest is verified, exactly, against the stored rows of the buckets whose filter matched.

1. The identifiers are stored once, in folders of their time bucket, with a fingerprint each.
2. Fingerprints go to shards. Each shard holds a filter for every time bucket, stored bit-sliced: the word at
   a bit position has one bit for each bucket, and a second word tells the positions that were set more than
   once. An identifier with a position in its own bucket that nobody else set was delivered once there; the AND
   of the words at its positions names every other bucket that may hold it. Who passes both is definitely new
   and is never looked at again. (Copies within one batch of rows are combined before they travel, so a message
   delivered a million times is a few rows.)
3. Only folders of buckets that matched are read again, and of their rows only those that the marks of the
   possible repeats let pass (a bit map of bounded size) are sent to be verified: compared by the identifier
   itself. Neither false positives of a filter nor equal fingerprints of different identifiers can therefore
   remove a row, and what travels for the verification is in proportion to the possible repeats.

Rows with a null identifier cannot repeat and stay. Ties on the sequence number cannot occur
(it is unique); the lowest one stays. Null times and times beyond 100 years share one bucket. Empty input
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.skew import skew_join
from thicket.session import Scratch

#: Buckets a machine word can name.
SLICES = 64
#: Bits per identifier of the fullest bucket, and positions set for each: fewer than one false positive
#: in a thousand for each bucket.
BITS_PER_ID = 16
HASHES = 7
#: Fingerprints a shard should hold.
SHARD_ROWS = 200_000
WEEK = 7 * 86400.0
#: Time buckets at most (weeks of 100 years); other times share one.
MOST_BUCKETS = 5200
#: Words of the bit map of possible repeats at most: a few MB.
MOST_WORDS = 1 << 20


def _positions(fp: np.ndarray, m: int) -> list[np.ndarray]:
    """Bit positions by double hashing of the two halves of a fingerprint."""
    u = fp.view(np.uint64)
    h1 = u & np.uint64(0xFFFFFFFF)
    h2 = (u >> np.uint64(32)) | np.uint64(1)
    return [((h1 + np.uint64(i) * h2) & np.uint64(m - 1)).astype(np.int64) for i in range(HASHES)]


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, tb, n): the copies of one fingerprint in one batch as one row."""
    for batch in batches:
        fp, tb = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "tb"))
        order = np.lexsort((tb, fp))
        fp, tb = fp[order], tb[order]
        first = np.flatnonzero(np.r_[True, (fp[1:] != fp[:-1]) | (tb[1:] != tb[:-1])]) if len(fp) else np.zeros(0, int)
        n = np.diff(np.r_[first, len(fp)])
        yield pa.RecordBatch.from_arrays([pa.array(fp[first]), pa.array(tb[first]), pa.array(n.astype(np.int64))], names=["fp", "tb", "n"])


def _screen(pdf: pd.DataFrame) -> pd.DataFrame:
    """Possible repeats of one shard: (fp, tb) of the row and of every bucket that matched, with its number of rows."""
    fp = pdf["fp"].to_numpy(np.int64)
    buckets, slot = np.unique(pdf["tb"].to_numpy(np.int64), return_inverse=True)
    n = pdf["n"].to_numpy(np.int64)
    rows, hits = [], []
    for first in range(0, len(buckets), SLICES):
        inside = np.flatnonzero((slot >= first) & (slot < first + SLICES))
        fullest = int(np.bincount(slot[inside] - first).max())
        m = 1 << max(6, int(np.ceil(np.log2(BITS_PER_ID * fullest))))
        once, again = np.zeros(m, np.uint64), np.zeros(m, np.uint64)
        at = (slot[inside] - first).astype(np.int64)
        bit = np.left_shift(np.uint64(1), at.astype(np.uint64))
        places = _positions(fp[inside], m)
        for p in places:
            np.bitwise_or.at(once, p, bit)
        # positions set more than once in a bucket, one identifier setting its own places counting as often as it was delivered
        spots = np.concatenate([p * SLICES + at for p in places])
        order = np.argsort(spots, kind="stable")
        spots, weight = spots[order], np.tile(n[inside], HASHES)[order]
        start = np.flatnonzero(np.r_[True, spots[1:] != spots[:-1]])
        many = spots[start][np.add.reduceat(weight, start) > 1]
        np.bitwise_or.at(again, many // SLICES, np.left_shift(np.uint64(1), (many % SLICES).astype(np.uint64)))
        own = bit.copy()
        for p in places:
            own &= again[p]
        mine = inside[own != 0]
        rows.append(mine)
        hits.append(slot[mine])
        match = np.full(len(fp), ~np.uint64(0))
        for p in _positions(fp, m):
            match &= once[p]
        match[inside] &= ~bit  # a bucket always holds its own rows
        left = np.flatnonzero(match)
        for b in range(min(SLICES, len(buckets) - first)):
            sel = left[(match[left] >> np.uint64(b)) & np.uint64(1) == 1]
            rows += [sel, sel]
            hits += [np.full(len(sel), first + b), slot[sel]]
    r, h = np.concatenate(rows), np.concatenate(hits)
    found = pd.DataFrame({"fp": fp[r], "tb": buckets[h]}).drop_duplicates()
    load = pd.DataFrame({"fp": fp, "tb": buckets[slot], "n": n}).merge(found, on=["fp", "tb"]).groupby(["fp", "tb"], as_index=False)["n"].sum()
    return found.merge(load, on=["fp", "tb"], how="left").fillna({"n": 0}).astype({"n": np.int64})


def repeats(
    df: DataFrame,
    id_cols: list[Column],
    seq: str,
    ts: str,
    bucket_seconds: float = WEEK,
    shard_rows: int = SHARD_ROWS,
    most_words: int = MOST_WORDS,
) -> DataFrame:
    """(seq) of the rows to remove: every copy of an identifier but the one with the lowest seq."""
    scratch = Scratch(df.sparkSession, "redelivery")
    names = [f"_k{i}" for i in range(len(id_cols))]
    week = F.floor(F.col(ts) / F.lit(bucket_seconds))
    tb = F.when(week.between(0, MOST_BUCKETS), week).otherwise(-1).cast("long")
    rows = df.select(F.col(seq).alias("seq"), tb.alias("tb"), *[c.alias(n) for c, n in zip(id_cols, names)])
    rows = rows.where(" AND ".join(f"{n} IS NOT NULL" for n in names)).withColumn("fp", F.xxhash64(*names))
    stored = scratch.save(rows, "stored", by=("tb",))

    size = stored.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    shards = max(1, -(-size // shard_rows))
    # other bits than those of the filter's positions choose the shard
    combined = stored.select("fp", "tb").mapInArrow(_combine, "fp long, tb long, n long")
    shard = F.pmod(F.hash("fp"), F.lit(shards))
    possible = combined.withColumn("shard", shard).groupBy("shard").applyInPandas(_screen, "fp long, tb long, n long")
    mark = F.xxhash64("fp", "tb")
    possible = scratch.save(possible.withColumn("mark", mark), "possible")
    seen = possible.agg(F.count(F.lit(1)).alias("n"), F.collect_set("tb").alias("tb")).first()  # at most MOST_BUCKETS + 1 buckets
    words = 1 << min(max(10, (seen["n"] // 4).bit_length()), most_words.bit_length() - 1)
    word, bit = F.pmod(F.col("mark"), F.lit(words)), F.pmod(F.shiftright("mark", 32), F.lit(64)).cast("int")
    one = F.lit(1).cast("long")
    bits = possible.select(word.alias("word"), F.call_function("shiftleft", one, bit).alias("b")).groupBy("word").agg(F.bit_or("b").alias("bits"))
    suspect = stored.where(F.col("tb").isin(seen["tb"]) if seen["tb"] else F.lit(False)).withColumn("mark", mark).withColumn("word", word)
    suspect = suspect.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(F.call_function("shiftleft", one, bit)) != 0)
    # fewer than 200 marks can stand for more than half a percent of the rows each
    heavy = possible.groupBy("mark").agg(F.sum("n").alias("n")).where(F.col("n") > max(2, size) / 200).select(F.col("mark").alias("key"))
    matched = skew_join(suspect.select("seq", "mark", *names), possible.select("mark").distinct(), "mark", "left_semi", heavy, row_hash=F.col("seq"))
    matched = scratch.save(matched.select("seq", *names), "matched")
    first = matched.groupBy(*names).agg(F.min("seq").alias("seq")).select("seq")
    return matched.select("seq").join(first, "seq", "left_anti")


def keep_one(df: DataFrame, id_cols: list[Column], seq: str, ts: str, **options) -> DataFrame:
    """``df`` without the repeated copies."""
    gone = repeats(df, id_cols, seq, ts, **options).withColumnRenamed("seq", seq)
    return df.join(gone, seq, "left_anti")
