"""Cutting lineage: tables written to the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Folders that one scan reads before a loop's rounds are written together.
MOST_FOLDERS = 24
#: Rows of ids (some ten bytes to a hundred each) that may be broadcast; their number is counted first.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; on a cluster it must be set, on one machine there's one of our own."""
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


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read again: a plan of one scan, safe against lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As ``settled``, in buckets by ``keys``: joins by them read the rows where they are and shuffle the other side alone."""
    spark = df.sparkSession
    path, n = fresh_path(spark, name), int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = path.rsplit("/", 1)[-1].replace("-", "_")
    df.repartition(n, *keys).write.bucketBy(n, *keys).option("path", path).saveAsTable(table)
    rows = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # from the catalogue; the files stay
    return rows


def counted(df: DataFrame, path: str) -> tuple[DataFrame, int]:
    """As ``settled``, and the number of rows, which the writing itself counts."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def deleted(spark: SparkSession, *paths: str) -> None:
    """Deletes written tables that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def small(df: DataFrame, n: int) -> DataFrame:
    """``df`` of ``n`` counted rows of ids: broadcast if they are few."""
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


class Rounds:
    """The tables that a loop writes, a folder a round. All of them are read by one scan, not by a union of many."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.base = spark, fresh_path(spark, name)
        self.paths: list[str] = []
        self.n, self.made = 0, 0

    def add(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The round as a table and its number of rows."""
        self.made += 1
        path = f"{self.base}/{self.made:05}"
        table, n = counted(df, path)
        if n or not self.paths:
            self.paths.append(path)
        self.n += n
        self.schema = table.schema
        return table, n

    def all(self) -> DataFrame:
        if len(self.paths) > MOST_FOLDERS:
            old, self.made = self.paths, self.made + 1
            self.paths = [f"{self.base}/{self.made:05}"]
            self.spark.read.schema(self.schema).parquet(*old).write.parquet(self.paths[0])
        return self.spark.read.schema(self.schema).parquet(*self.paths)
