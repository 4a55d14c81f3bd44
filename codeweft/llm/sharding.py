"""Sharding by Karmarkar-Karp differencing.

Documents with equal texts form one indivisible group. Groups are put into ``n_shards`` shards so
that the shards' bytes are as near equal as the groups allow: the two partial partitions with the
largest spread are combined again and again, the fullest part of one with the emptiest of the other.

One heap over all groups would be a single task, so the work is done in two levels:

* Groups that hold at least 1/64 of a shard's mean bytes (at most ``64 * n_shards`` exist) are
  differenced on the driver.
* All other groups are hashed into buckets of about ``groups_per_bucket``; each bucket is
  differenced in a task of its own, on top of its proportional part of the loads that the large
  groups left. So small groups fill up what the large ones leave open.

Groups that hold at least 1/(64 n_shards) of the rows reach their rows by a broadcast join (their
number has the same bound); the others by a shuffle join. So no hot text gathers in one task.

Defined results: a null text has 0 bytes, crc32 0 and forms a group of its own, apart from the
empty text. Repeated rows are rows like others (one result row each, one shard, slots of their own).
An empty table gives an empty result. Columns other than the two named are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, table, written

ROW_BYTES = 16
LARGE = 64


def differencing(sizes: Sequence[int], n_shards: int, preload: Sequence[int] | None = None) -> np.ndarray:
    """The shard of each size. ``preload``: bytes that the shards hold already."""
    k, n = n_shards, len(sizes)
    vectors: list[np.ndarray | None] = []
    heap: list[tuple[int, int]] = []
    for i, size in enumerate(sizes):
        v = np.zeros(k, dtype=np.int64)
        v[k - 1] = size
        vectors.append(v)
        heap.append((-int(size), i))
    order = None
    if preload is not None:
        loads = np.asarray(preload, dtype=np.int64)
        order = np.argsort(loads, kind="stable")
        vectors.append(loads[order])
        heap.append((-int(loads.max() - loads.min()), n))
    if not heap:
        return np.zeros(0, dtype=np.int32)
    heapq.heapify(heap)
    joins: list[tuple[int, int, np.ndarray]] = []
    first = len(vectors)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = vectors[a] + vectors[b][::-1]
        by = np.argsort(both, kind="stable")
        v = both[by]
        vectors[a] = vectors[b] = None
        joins.append((a, b, by))
        vectors.append(v)
        heapq.heappush(heap, (-int(v[-1] - v[0]), first + len(joins) - 1))
    # From the last partition down: which shard each position of each partial partition became.
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(k, dtype=np.int32)}
    for j in range(len(joins) - 1, -1, -1):
        a, b, by = joins[j]
        of = np.empty(k, dtype=np.int32)
        of[by] = place.pop(first + j)
        place[a], place[b] = of, of[::-1]
    shard = np.fromiter((place[i][k - 1] for i in range(n)), dtype=np.int32, count=n)
    if order is not None:
        rename = np.empty(k, dtype=np.int32)
        rename[place[n]] = order
        shard = rename[shard]
    return shard


def shard_documents(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", groups_per_bucket: int = 20_000) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    spark, text = docs.sparkSession, F.col(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(ROW_BYTES)).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.md5(text), F.lit("")).alias("grp"),
        ),
        "shard-rows",
    )
    groups = written(rows.groupBy("grp").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")), "shard-groups")
    total, n_rows, n_groups = groups.agg(F.sum("bytes"), F.sum("n"), F.count("*")).first()
    total, n_rows = total or 0, n_rows or 0
    heavy = F.col("bytes") * (n_shards * LARGE) >= F.lit(total)
    # At most n_shards * LARGE rows.
    large = groups.where(heavy).select("grp", "bytes").orderBy(F.desc("bytes"), "grp").collect()
    placed = differencing([r["bytes"] for r in large], n_shards)
    loads = np.zeros(n_shards, dtype=np.int64)
    np.add.at(loads, placed, np.array([r["bytes"] for r in large], dtype=np.int64))
    rest, n_buckets = max(1, total - int(loads.sum())), max(1, -(-n_groups // groups_per_bucket))
    held = [int(x) for x in loads]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "grp"], ascending=[False, True])
        own = int(pdf["bytes"].sum())
        shards = differencing(pdf["bytes"].tolist(), n_shards, [x * own // rest for x in held] if any(held) else None)
        if not any(held):  # else every bucket's fullest part would have the same number
            turn = int(pdf["bucket"].iloc[0]) * 7919
            shards = (shards + turn) % n_shards
        return pd.DataFrame({"grp": pdf["grp"], "n": pdf["n"], "shard": shards.astype("int32")})

    small = groups.where(~heavy).withColumn("bucket", F.pmod(F.xxhash64("grp"), F.lit(n_buckets)))
    assigned = small.groupBy("bucket").applyInPandas(one, "grp string, n long, shard int")
    if large:
        known = spark.createDataFrame(
            pd.DataFrame({"grp": [r["grp"] for r in large], "shard": placed.astype("int32")}), "grp string, shard int"
        ).join(groups, "grp").select("grp", "n", "shard")
        assigned = assigned.unionByName(known)
    assigned = written(assigned, "shard-assigned")
    hot = F.col("n") * (n_shards * LARGE) >= F.lit(n_rows)
    heads = F.broadcast(assigned.where(hot).select("grp", "shard"))  # at most n_shards * LARGE rows
    tails = assigned.where(~hot).select("grp", F.col("shard").alias("own"))
    marked = rows.join(heads, "grp", "left")
    out = marked.where("shard is not null").select("doc_id", "size", "text_crc32", "shard").unionByName(
        marked.where("shard is null").drop("shard").join(tails, "grp").select("doc_id", "size", "text_crc32", F.col("own").alias("shard"))
    )
    out = written(out.withColumn("sub", F.spark_partition_id()), "shard-placed")
    dropped(spark, rows, groups, assigned)
    starts = out.groupBy("shard", "sub").count().withColumn(
        "start", F.sum("count").over(Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1))
    ).select("shard", "sub", F.coalesce("start", F.lit(0)).alias("start"))
    return out.join(starts, ["shard", "sub"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32")) - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 40 shards by the law ``bytes``; a row a document, a null text has 0 bytes."""
    return shard_documents(table(spark, sf_dir, "documents"))
