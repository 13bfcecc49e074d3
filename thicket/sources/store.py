"""Tables of the memory on a file system without a table format.

A table is a folder of written parts and numbered pointers; a pointer names the parts of one state, and the
one with the highest number is the current state. A pointer is written to the side and renamed to its number, which fails if
another writer took that number first (the change is then made again on the new state). Readers therefore always find
a whole state, also while a pointer is written, and a failed write leaves the last one where it was.

A table with keys is kept in buckets of the hash of its keys, each part a folder of the buckets it holds:
upserting, patching and deleting read and write only the buckets of the keys they touch; appending writes one
part, however large the table. Older parts stay until ``vacuum``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 32
_BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer was first, several times in a row."""


class Store:
    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, tries: int = 5):
        self.spark, self.root, self.buckets, self.tries = spark, root.rstrip("/"), buckets, tries
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, p: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        return path, path.getFileSystem(self._conf)

    def _state(self, name: str) -> tuple[int, list[str], list[str]]:
        """(number, keys, folders) of the current state; number 0 if the table does not exist."""
        folder, fs = self._path(f"{self.root}/{name}")
        if not fs.exists(folder):
            return 0, [], []
        last = max((int(leaf[2:]) for x in fs.listStatus(folder) if (leaf := x.getPath().getName()).startswith("v-")), default=0)
        if not last:
            return 0, [], []
        # a pointer is a few lines: the keys, then a folder each
        stream = fs.open(self._path(f"{self.root}/{name}/v-{last:012d}")[0])
        lines = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n")
        stream.close()
        return last, [k for k in lines[0].split(",") if k], [x for x in lines[1:] if x]

    def current(self, name: str) -> list[str]:
        """The folders of the current state; none if the table does not exist."""
        return self._state(name)[2]

    def _open(self, name: str, folders: list[str]) -> DataFrame | None:
        if not folders:
            return None
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.root}/{name}/{p}" for p in folders])

    def read(self, name: str) -> DataFrame | None:
        return self._open(name, self.current(name))

    def _change(self, name: str, change: Callable[[list[str], list[str]], tuple[list[str], list[str]]]) -> None:
        """Points to what ``change`` makes of (keys, folders); made again if another writer was first."""
        for _ in range(self.tries):
            number, keys, folders = self._state(name)
            if self._point(name, number + 1, *change(keys, folders)):
                return
        raise Conflict(name)

    def _point(self, name: str, number: int, keys: list[str], folders: list[str]) -> bool:
        side, fs = self._path(f"{self.root}/{name}/w-{uuid.uuid4().hex[:12]}")
        out = fs.create(side, False)
        out.write(bytearray("\n".join([",".join(keys), *folders]).encode()))
        out.close()
        target = self._path(f"{self.root}/{name}/v-{number:012d}")[0]
        won = not fs.exists(target) and fs.rename(side, target)
        if not won:
            fs.delete(side, False)
        return won

    def _write(self, name: str, df: DataFrame, keys: list[str]) -> list[str]:
        """Writes a part; returns its folders, one for each bucket if the table has keys."""
        part = f"s-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/{name}/{part}"
        if not keys:
            df.write.parquet(path)
            return [part]
        self._bucketed(df, keys).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(path)
        folder, fs = self._path(path)
        return sorted(f"{part}/{leaf}" for x in fs.listStatus(folder) if (leaf := x.getPath().getName()).startswith(_BUCKET))

    def _empty(self, name: str, df: DataFrame) -> list[str]:
        """A part without rows, so that an empty table keeps its columns."""
        part = f"s-{uuid.uuid4().hex[:12]}"
        df.limit(0).coalesce(1).write.parquet(f"{self.root}/{name}/{part}/{_BUCKET}=-1")
        return [f"{part}/{_BUCKET}=-1"]

    def _bucketed(self, df: DataFrame, keys: list[str]) -> DataFrame:
        # as text, so that keys of different number types fall into one bucket
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(self.buckets)).cast("int"))

    def near(self, name: str, rows: DataFrame, keys: list[str]) -> DataFrame | None:
        """The stored rows of the buckets that the keys of ``rows`` fall into: all that may have one of these keys."""
        _, own, folders = self._state(name)
        if own == keys and folders:
            hit = {r[_BUCKET] for r in self._bucketed(rows.select(*keys), keys).select(_BUCKET).distinct().collect()}
            folders = [f for f in folders if int(f.rsplit("=", 1)[1]) in hit]
        return self._open(name, folders)

    def replace(self, name: str, df: DataFrame, keys: list[str] | None = None) -> None:
        """The table from now on; ``keys`` are those it is bucketed by (those it had, if not given)."""
        own = keys if keys is not None else self._state(name)[1]
        folders = self._write(name, df, own) or self._empty(name, df)
        self._change(name, lambda _, old: (own, folders))

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows without touching those that are there."""
        keys = self._state(name)[1]
        folders = self._write(name, rows, keys)

        def add(now: list[str], old: list[str]) -> tuple[list[str], list[str]]:
            if now != keys:
                raise Conflict(name)
            return now, [*old, *folders]

        self._change(name, add)

    def _touch(self, name: str, changed: DataFrame, keys: list[str], make: Callable[[DataFrame | None], DataFrame]) -> None:
        """Rewrites the buckets of the keys in ``changed`` with what ``make`` gives for their rows."""

        def change(now: list[str], folders: list[str]) -> tuple[list[str], list[str]]:
            if folders and now != keys:  # bucketed otherwise so far: all of it once
                out = make(self._open(name, folders))
                return keys, self._write(name, out, keys) or self._empty(name, out)
            hit = {r[_BUCKET] for r in self._bucketed(changed.select(*keys), keys).select(_BUCKET).distinct().collect()}
            mine = [f for f in folders if int(f.rsplit("=", 1)[1]) in hit]
            out = make(self._open(name, mine))
            return keys, [*(f for f in folders if f not in mine), *self._write(name, out, keys)] or self._empty(name, out)

        self._change(name, change)

    def upsert(self, name: str, rows: DataFrame, keys: list[str], order: Column | None = None) -> None:
        """Rows replace those with the same keys; of several new rows with one key the last by ``order`` counts."""
        if order is not None:
            cols = [c for c in rows.columns if c not in keys]
            rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), order).alias("r")).select(*keys, "r.*")
        else:
            rows = rows.dropDuplicates(keys)
        self._touch(name, rows, keys, lambda old: rows if old is None else conform(old, rows.schema).join(rows, keys, "left_anti").unionByName(rows, allowMissingColumns=True))

    def patch(self, name: str, changes: DataFrame, keys: list[str], nulls: bool = False) -> None:
        """Values of ``changes`` overwrite the columns of rows with the same keys: non-null ones, or all with ``nulls``."""
        cols = [c for c in changes.columns if c not in keys]
        new = changes.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_n_{c}") for c in cols])
        pick = lambda c: F.when(F.col("_hit"), F.col(f"_n_{c}")).otherwise(F.col(c)) if nulls else F.coalesce(f"_n_{c}", c)

        def make(old: DataFrame | None) -> DataFrame:
            if old is None:
                return changes.limit(0)
            return old.join(new, keys, "left").select(*[pick(c).alias(c) if c in cols else F.col(c) for c in old.columns])

        self._touch(name, changes, keys, make)

    def delete(self, name: str, keys_to_drop: DataFrame, keys: list[str]) -> None:
        self._touch(name, keys_to_drop, keys, lambda old: keys_to_drop.limit(0) if old is None else old.join(keys_to_drop.select(*keys), keys, "left_anti"))

    def backup(self, name: str, target: str) -> int:
        """The current state as a table of another store, and its rows."""
        now = self.read(name)
        if now is None:
            return 0
        other = Store(self.spark, target, self.buckets)
        other.replace(name, now, self._state(name)[1])
        return other.read(name).count()

    def restore(self, name: str, source: str) -> None:
        """The state that was backed up becomes the current one; the one before stays until ``vacuum``."""
        old = Store(self.spark, source, self.buckets)
        self.replace(name, old.read(name), old._state(name)[1])

    def vacuum(self, name: str) -> int:
        """Removes all parts that the current state does not name, and older pointers; returns how many parts."""
        number, _, folders = self._state(name)
        keep, gone = {f.split("/")[0] for f in folders}, 0
        folder, fs = self._path(f"{self.root}/{name}")
        for status in fs.listStatus(folder):
            leaf = status.getPath().getName()
            if leaf.startswith("s-") and leaf not in keep:
                fs.delete(status.getPath(), True)
                gone += 1
            elif leaf.startswith("v-") and int(leaf[2:]) < number:
                fs.delete(status.getPath(), False)
        return gone


def conform(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with the columns of a schema that it lacks, as defaults or nulls."""
    missing = {f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df
