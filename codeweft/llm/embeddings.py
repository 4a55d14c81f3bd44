"""Near-duplicate embeddings by product quantisation.

1. Equal vectors of one label are one; the copy with the smallest id stands for all.
2. The coarse quantiser is itself a product: each half of a vector has ``k`` centroids, a list is a pair
   of them, so k * k lists need a sample for k centroids alone. ``k`` grows with the square root of
   the number of vectors (``ROWS_PER_LIST`` vectors a list) up to ``MOST_CENTROIDS``, a million lists.
   On the residuals a product quantiser (``SUBSPACES`` codebooks of ``CODES`` centroids) is fitted,
   both on a sample of at most about ``SAMPLE`` vectors, a documented bound. Every vector is indexed: it
   stands in its ``PROBES`` nearest lists, with its residual codes in each, and probes the same lists.
3. Within a list of a label, each vector's inner products with the codes of the others are looked up
   in a table of its products with all code words (asymmetric: the query isn't quantised). Those
   that reach the threshold less the quantiser's error (its ``ERROR_QUANTILE`` on the sample) are
   reranked by the exact cosine in double precision. A pair that meets in several lists counts in
   the first alone.
4. Long lists are cut into chunks that are compared pairwise, each pair in a task of its own. A task
   returns link counts by vector and a spanning forest of its links, never the pairs.

Defined results: vectors that are null, zero or hold null or non-finite components, and those with
a null label, link with nothing (n_links 0, their own component). Vectors of fewer components than
others count as filled up with zeros. A row with a null id is not linked; its component_id is null,
kept true. Rows that repeat an id are vectors of their own that share a node. An empty table gives
an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, lean, small_batches, table, written
from .components import components, roots

SAMPLE = 40_000
SUBSPACES, CODES = 16, 256
PROBES = 8
MOST_CENTROIDS = 1024
ROWS_PER_LIST = 100
ERROR_QUANTILE = 0.9995
CHUNK = 4096


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, centers, 1)[:, 0]
        n = np.bincount(own, minlength=len(centers))
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        there = n > 0
        centers[there] = sums[there] / n[there, None]
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centers of each row, nearest first."""
    n = min(n, len(centers))
    out = np.empty((len(x), n), dtype=np.int64)
    half = (centers**2).sum(axis=1) / 2
    for a in range(0, len(x), 4096):
        far = half[None, :] - x[a : a + 4096] @ centers.T
        if n == 1:
            out[a : a + 4096, 0] = far.argmin(axis=1)
        else:
            part = np.argpartition(far, n - 1, axis=1)[:, :n]
            order = np.take_along_axis(far, part, axis=1).argsort(axis=1, kind="stable")
            out[a : a + 4096] = np.take_along_axis(part, order, axis=1)
    return out


@dataclass
class Index:
    #: Centroids of the first and of the second half of the components.
    halves: tuple[np.ndarray, np.ndarray]
    #: Column ranges of the subspaces and their code words.
    cuts: list[tuple[int, int]]
    words: list[np.ndarray]
    #: What an approximate product may fall short of the exact one.
    error: float

    def lists(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each row (all, if there are fewer), nearest first."""
        a, b = self.halves
        cut, m = a.shape[1], len(b)
        n, top = min(n, len(a) * m), (min(n, len(a)), min(n, m))
        out = np.empty((len(x), n), dtype=np.int64)
        for k in range(0, len(x), 4096):
            near, far = [], []
            for half, part, t in ((a, x[k : k + 4096, :cut], top[0]), (b, x[k : k + 4096, cut:], top[1])):
                near.append(_nearest(part, half, t))
                far.append((half**2).sum(axis=1)[near[-1]] / 2 - np.einsum("ij,ikj->ik", part, half[near[-1]]))
            both = (far[0][:, :, None] + far[1][:, None, :]).reshape(len(near[0]), -1)
            order = both.argsort(axis=1, kind="stable")[:, :n]
            out[k : k + 4096] = np.take_along_axis(near[0], order // top[1], axis=1) * m + np.take_along_axis(near[1], order % top[1], axis=1)
        return out

    def centers(self, lists: np.ndarray) -> np.ndarray:
        a, b = self.halves
        return np.concatenate([a[lists // len(b)], b[lists % len(b)]], axis=-1)

    def codes(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        rest = x - self.centers(lists)
        return np.stack([_nearest(rest[:, a:b], w, 1)[:, 0] for (a, b), w in zip(self.cuts, self.words, strict=True)], axis=1).astype(np.uint8)

    def products(self, queries: np.ndarray, center: int, codes: np.ndarray) -> np.ndarray:
        """Approximate inner products of whole queries with coded vectors of one list, by table look-up."""
        out = np.repeat((queries @ self.centers(np.int64(center)))[:, None], len(codes), axis=1)
        for k, ((a, b), w) in enumerate(zip(self.cuts, self.words, strict=True)):
            out += (queries[:, a:b] @ w.T)[:, codes[:, k]]
        return out


def centroids_for(n: int, sampled: int) -> int:
    """Centroids of each half for n vectors, of which so many are in the sample."""
    return max(1, min(MOST_CENTROIDS, int((n / ROWS_PER_LIST) ** 0.5), sampled // 20))


def fit_index(sample: np.ndarray, k: int, seed: int = 5) -> Index:
    dim = sample.shape[1]
    cut = (dim + 1) // 2
    index = Index((_kmeans(sample[:, :cut], k, seed), _kmeans(sample[:, cut:], k, seed + 99)), [], [], 0.0)
    own = index.lists(sample, PROBES)
    rng = np.random.default_rng(seed)
    # Residuals against one of each vector's lists, near or less near.
    pick = own[np.arange(len(sample)), rng.integers(0, own.shape[1], len(sample))]
    rest = (sample - index.centers(pick))[:SAMPLE]
    edges = np.linspace(0, dim, min(SUBSPACES, dim) + 1).astype(int)
    index.cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
    index.words = [_kmeans(rest[:, a:b], CODES, seed + 1 + k) for k, (a, b) in enumerate(index.cuts)]
    # The error that counts is that of a near vector's product: x.y - x.q(y) for x close to y.
    gaps = []
    for k in range(own.shape[1]):
        some, at = sample[:4000], own[:4000, k]
        codes = index.codes(some, at)
        back = index.centers(at) + np.concatenate([w[codes[:, j]] for j, w in enumerate(index.words)], axis=1)
        gaps.append(((some - back) * some).sum(axis=1))
    index.error = float(np.quantile(np.concatenate(gaps), ERROR_QUANTILE)) + 0.05
    return index


def _unit(rows: list, dim: int) -> np.ndarray:
    x = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        x[i, : len(r)] = r
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def embedding_duplicates(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", probes: int = PROBES, one_task: int = 2_000_000) -> DataFrame:
    """vec_id, n_links, component_id, kept; a row a vector."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & F.col("v").isNotNull() & F.col("vec_id").isNotNull()
    fine = fine & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    key = [F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(7), "v").alias("k2")]
    keyed = written(rows.select("vec_id", "label", F.coalesce(fine, F.lit(False)).alias("fine"), F.when(fine, F.col("v")).alias("v"), *key), "vectors")
    real = keyed.where("fine")
    distinct = written(real.groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "distinct-vectors")
    total, n, dim = real.count(), *distinct.agg(F.count("*"), F.max(F.size("v"))).first()
    alone = keyed.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not n:
        return alone.withColumn("kept", F.lit(True))
    rate = min(1.0, SAMPLE / n)
    drawn = distinct.where(F.pmod(F.xxhash64(F.lit("index sample"), "k1"), F.lit(1_000_000)) < rate * 1_000_000).select("v").toPandas()["v"].tolist()
    drawn = drawn or distinct.select("v").limit(1).toPandas()["v"].tolist()
    index = spark.sparkContext.broadcast(fit_index(_unit(drawn, dim), centroids_for(n, len(drawn))))

    def assign(batches):
        own = index.value
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                x = _unit(part.column(3).to_pylist(), dim)
                lists = own.lists(x, probes)
                width = lists.shape[1]
                at = np.repeat(np.arange(len(x)), width)
                flat = lists.reshape(-1)
                codes = own.codes(x[at], flat)
                take = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(take),
                        part.column(1).take(take),
                        part.column(2).take(take),
                        pa.array(flat.astype(np.int32)),
                        pa.array([lists[i].astype(np.int32) for i in at], pa.list_(pa.int32())),
                        pa.array([c.tobytes() for c in codes], pa.binary()),
                        part.column(3).take(take),
                    ],
                    names=["rep", "label", "copies", "list", "lists", "codes", "v"],
                )

    kind = "float" if dict(vectors.dtypes)[vector_col] == "array<float>" else "double"  # no wider than it came
    entries = distinct.select("rep", "label", "copies", F.col("v").cast(f"array<{kind}>").alias("v")).mapInArrow(
        lean(assign), f"rep long, label string, copies long, list int, lists array<int>, codes binary, v array<{kind}>"
    )
    entries = written(entries, "inverted-lists")
    sizes = entries.groupBy("label", "list").agg(F.ceil(F.count("*") / F.lit(CHUNK)).cast("int").alias("chunks"))
    placed = entries.join(sizes, ["label", "list"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    placed = placed.withColumn("to", F.explode(to)).select("label", "list", "to.i", "to.j", "chunk", "rep", "copies", "lists", "codes", "v")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        own = index.value
        center, i, j = int(pdf["list"].iloc[0]), int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        ids, copies, chunk = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(), pdf["chunk"].to_numpy()
        x = _unit(pdf["v"].tolist(), dim)
        lists = np.stack(pdf["lists"].to_list())
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in pdf["codes"]])
        counts = np.zeros(len(ids), dtype=np.int64)
        root = np.arange(len(ids))
        left, right = (np.flatnonzero(chunk == i), np.flatnonzero(chunk == j))
        for a in range(0, len(left), 256):
            some = left[a : a + 256]
            near = own.products(x[some], center, codes[right]) >= threshold - own.error
            near |= (own.products(x[right], center, codes[some]) >= threshold - own.error).T
            if near.sum() * 8 > near.size:  # one product of matrices takes less than that many single ones
                near &= x[some] @ x[right].T >= threshold
                p, q = np.nonzero(near)
            else:
                p, q = np.nonzero(near)
                exact = (x[some[p]] * x[right[q]]).sum(axis=1) >= threshold
                p, q = p[exact], q[exact]
            p, q = some[p], right[q]
            if i == j:
                p, q = p[p < q], q[p < q]
            # The first list that both stand in counts.
            both = (lists[p][:, :, None] == lists[q][:, None, :]).any(axis=2)
            first = np.where(both, lists[p], np.iinfo(np.int32).max).min(axis=1, initial=np.iinfo(np.int32).max) == center
            p, q = p[first], q[first]
            np.add.at(counts, p, copies[q])
            np.add.at(counts, q, copies[p])
            apart = np.unique(np.sort(np.stack([root[p], root[q]], axis=1)[root[p] != root[q]], axis=1), axis=0)
            if len(apart):  # links between trees of the forest so far
                to = np.arange(len(ids))
                for k, r in roots(apart.tolist()).items():
                    to[k] = r
                root = to[root]
        links = [(int(r), k) for k, r in enumerate(root.tolist()) if r != k]
        some = np.flatnonzero(counts)
        return pd.concat(
            [
                pd.DataFrame({"a": ids[some], "b": pd.array([None] * len(some), dtype="Int64"), "n": counts[some]}),
                pd.DataFrame({"a": [int(ids[r]) for r, _ in links], "b": pd.array([int(ids[k]) for _, k in links], dtype="Int64"), "n": [0] * len(links)}),
            ]
        ).astype({"a": "int64", "b": "Int64", "n": "int64"})

    found = written(placed.groupBy("label", "list", "i", "j").applyInPandas(compare, "a long, b long, n long"), "vector-links")
    label = components(found.where("b is not null").select("a", "b"), one_task).withColumnRenamed("node", "rep")
    counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    named = distinct.select("label", "k1", "k2", "rep", "copies").join(label, "rep", "left").join(counts, "rep", "left")
    named = written(named.select("label", "k1", "k2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "vector-components")
    out = hot_join(real.select("vec_id", "label", "k1", "k2"), named, ["label", "k1", "k2"], "copies", total)
    out = out.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_embedding_duplicates(spark, sf_dir: str) -> DataFrame:
    """Links and components of all rows of ``embeddings``; a row a vector, see above for nulls and repeats."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


OP7_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT a AS vec_id, a AS reached FROM (SELECT DISTINCT a FROM l) UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.reached = l.a),
c AS (SELECT vec_id, min(reached) AS component FROM r GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.component, e.vec_id) AS component_id, e.vec_id = coalesce(c.component, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
