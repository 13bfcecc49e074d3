"""Session, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "*", shuffle_partitions: int = 8, app: str = "thicket") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    package = Path(__file__).resolve().parent
    folder = Path(tempfile.mkdtemp(prefix="thicket-code-"))
    atexit.register(shutil.rmtree, folder, True)
    with zipfile.ZipFile(folder / "thicket_code.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(folder / "thicket_code.zip"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a Parquet file or a folder of Parquet files."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only where the session names none and runs on a single machine (tests) a folder of this
    process is used; on a cluster, whose executors would not share it, that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get().rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="thicket-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Scratch:
    """Written tables that cut lineage.

    A table is written once to the shared folder and read back with its known schema,
    so a lost executor costs a read and never a recomputation of an iteration. Tables
    are dropped when a later round replaces them, the rest by ``release`` once the result is written, or when the
    process ends.
    """

    _open: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._count = 0
        if not Scratch._open:
            atexit.register(release)
        Scratch._open.append(self)

    def save(self, df: DataFrame, label: str = "t", by: tuple[str, ...] = ()) -> DataFrame:
        """``by`` names the columns whose values part the table into folders (they come last in it)."""
        self._count += 1
        path = f"{self.root}/{label}-{self._count}"
        df = df.select(*[c for c in df.columns if c not in by], *by)
        df.write.mode("overwrite").option("compression", "zstd").partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def append(self, df: DataFrame, label: str) -> DataFrame:
        """Adds rows to one table and reads all of it back, as one scan however often it grew."""
        path = f"{self.root}/{label}"
        df.write.mode("append").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                self._delete(path)

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(since: int = 0) -> None:
    """Drops the scratch tables opened after the first ``since``: a long session calls it once results are written."""
    while len(Scratch._open) > since:
        Scratch._open.pop().close()


def parallelism(spark: SparkSession, rows: int = 0, rows_per_task: int = 4_000_000) -> int:
    """Tasks that run at once, at least the shuffle partitions set for the session, and more where ``rows`` need them."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
