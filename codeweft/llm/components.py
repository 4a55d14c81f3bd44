"""Connected components of a table of links.

Each task first replaces its own links by a spanning forest. Then either the links that are left are
few (at most ``one_task``, 16 bytes each) and one task finishes them, or large-star and small-star
rounds, each written to the shared folder, go on until nothing changes. Nothing reaches the driver
but counts.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


class Forest:
    """Union-find of whole numbers; a tree's root is its smallest member."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        top, up = x, self.up
        while (p := up.setdefault(top, top)) != top:
            top = p
        while up[x] != top:
            up[x], x = top, up[x]
        return top

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def roots(pairs) -> dict[int, int]:
    """The smallest member of each node's component."""
    forest = Forest()
    for a, b in pairs:
        forest.link(a, b)
    return {x: forest.find(x) for x in list(forest.up)}


def _stars(frames):
    """(root, node) links of each partition; its memory follows the nodes, not the links."""
    forest = Forest()
    for pdf in frames:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            forest.link(a, b)
    nodes = list(forest.up)
    for k in range(0, len(nodes), 100_000):
        some = [(forest.find(x), x) for x in nodes[k : k + 100_000]]
        yield pd.DataFrame([(r, x) for r, x in some if r != x], columns=["a", "b"], dtype="int64")


def components(links: DataFrame, one_task: int = 2_000_000, max_rounds: int = 60) -> DataFrame:
    """``links``: a, b (long, no nulls). (node, component) of all nodes that have a link to another; component: its smallest node."""
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(links.mapInPandas(_stars, "a long, b long").distinct(), "links")
    n = edges.count()
    if n <= one_task:
        done = written(edges.coalesce(1).mapInPandas(_stars, "a long, b long"), "components")
        return done.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(done.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = written(large, "large-star")
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m").alias("a"), "b").unionByName(large.join(lower, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b")
        fresh = written(small.distinct(), "small-star")
        moved = fresh.exceptAll(edges).limit(1).count() + (fresh.count() != edges.count())
        dropped(edges.sparkSession, large, edges)
        edges = fresh
        if not moved:
            break
    else:
        raise RuntimeError("components did not converge")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
