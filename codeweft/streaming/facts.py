"""Structured Streaming of facts: an extension; batch results and streamed ones are the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import upsert


class NodeTable:
    """Nodes kept up to date from a stream of node facts; a table a version, the last complete one counts.

    A micro-batch that is delivered again writes the same version again, so replays change nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        top = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not self._fs.exists(top):
            return []
        done = lambda p: self._fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return sorted(int(s.getPath().getName()[8:]) for s in self._fs.listStatus(top) if s.getPath().getName().startswith("version=") and done(s.getPath()))

    def read(self, before: int | None = None) -> DataFrame | None:
        found = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/version={found[-1]}") if found else None

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch."""
        old = self.read(before=batch_id)
        shift = 0 if old is None else old.agg(F.coalesce(F.max("node_seq"), F.lit(-1))).first()[0] + 1
        fresh = batch.withColumn("node_seq", F.col("node_seq") + F.lit(shift))
        upsert(fresh if old is None else old.unionByName(fresh, allowMissingColumns=True)).write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")

    def follow(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint)


def call_counts(stream: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """``stream``: ts, src, dst. Calls seen by window and callee, with late data up to a bound."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "dst").agg(F.count("*").alias("n"))
