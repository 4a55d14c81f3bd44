"""What the operators of this subpackage share: the shared folder, written tables, words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the near-duplicate contract has them: runs of anything but space, \t, \n, \v, \f, \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, one of our own on one machine (tests), an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="codeweft-")
        atexit.register(shutil.rmtree, own, True)
        found = f"file://{own}"
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cuts lineage: ``df`` as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes written tables that no later step reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


#: What crosses between the JVM and Python at once: texts of any length, so bytes count, not rows alone.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20
#: What modules keep in a worker between tasks, by name: how to drop it.
CACHES: dict[str, Callable[[], None]] = {}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of an Arrow batch where they are higher."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def lean(run, keeps: str = ""):
    """A function of batches for a worker that others use next: caches but that of ``keeps`` are dropped
    before it, and at its end what was freed goes back to the machine."""

    def wrapped(batches):
        for name, drop in CACHES.items():
            if name != keeps:
                drop()
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_join(rows: DataFrame, keyed: DataFrame, keys: list[str], n_col: str, total: int, parts: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has one row a key and the number of rows of that key in ``n_col``.

    Keys that hold over 1/``parts`` of the rows (fewer than ``parts`` of them) go by broadcast, so their
    rows stay where they are; the others by a shuffle in which no key is hot.
    """
    rest = [c for c in keyed.columns if c not in (*keys, n_col)]
    hot = F.col(n_col) * parts > F.lit(total)
    head = F.broadcast(keyed.where(hot).select(*keys, *[F.col(c).alias(f"__hot_{c}") for c in rest], F.lit(True).alias("__hot")))
    marked = rows.join(head, keys, "left")
    names = rows.columns
    first = marked.where("__hot").select(*names, *[F.col(f"__hot_{c}").alias(c) for c in rest])
    second = marked.where("__hot is null").select(*names).join(keyed.where(~hot).select(*keys, *rest), keys).select(*names, *rest)
    return first.unionByName(second)
