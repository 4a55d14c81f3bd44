"""Level-synchronous traversals: one job and one written table a level, in which the frontier meets the
edges and what was visited drops out. The writing counts the rows, so a frontier is broadcast while it is
small by that count, and shuffled when it isn't."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import ANNOTATION_KINDS, Graph
from ..store import Rounds, settled, small

FLOW_KINDS = ("Reads", "Writes", "BindsTo", "Calls", "InjectedInto", "ReturnsView", "Contains")
RENDER_KINDS = ("UsesLayout", "RendersPartial", "RendersComponent", "DefinesSection")
DIRECTIONS = ("outgoing", "incoming", "both")


def oriented(edges: DataFrame, kinds: Sequence[str] | None, direction: str) -> DataFrame:
    """src, dst, type, edge_seq of the edges to follow. Without kinds: all but annotations."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}: {direction!r}")
    rows = edges.where(F.col("type").isin(*kinds) if kinds is not None else ~F.col("type").isin(*ANNOTATION_KINDS)).select("src", "dst", "type", "edge_seq")
    back = rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", "edge_seq")
    return {"outgoing": rows, "incoming": back}.get(direction) or rows.unionByName(back)


def bfs(starts: DataFrame, steps: DataFrame, max_depth: int | None, keys: Sequence[str] = (), free: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(keys, node, depth, edge_seq) of all that is reached, starts included at depth 0.

    ``starts``: keys and node; ``steps`` and ``free``: src, dst, edge_seq; steps cost 1, free ones 0.
    Depth is the least cost; edge_seq the smallest edge on which a node is first reached. With ``ids``
    (node_id) other nodes are neither shown nor passed. They are looked up for the frontier of each
    level, whose size is known, so neither the edges nor the ids are shuffled while it is small.
    """
    by, spark = [*keys, "node"], starts.sparkSession
    rounds = Rounds(spark, "reached")

    def known(found: DataFrame, n: int) -> DataFrame:
        return small(found, n) if ids is None else ids.select(F.col("node_id").alias("node")).join(small(found, n), "node").select(*found.columns)

    def hop(frontier: DataFrame, n: int, table: DataFrame, depth: int) -> tuple[DataFrame, int]:
        at = known(frontier.select(*by), n).select(*keys, F.col("node").alias("src"))
        found = table.select("src", "dst", "edge_seq").join(small(at, n), "src").groupBy(*keys, F.col("dst").alias("node")).agg(F.min("edge_seq").alias("edge_seq"))
        found = found.join(small(rounds.all().select(*by), rounds.n), by, "left_anti").withColumn("depth", F.lit(depth))
        return rounds.add(found.select(*by, "edge_seq", "depth"))

    frontier, n = rounds.add(starts.select(*by).distinct().select(*by, F.lit(None).cast("long").alias("edge_seq"), F.lit(0).alias("depth")))
    depth = 0
    while n:
        fresh, m = frontier, n
        while free is not None and m:
            fresh, m = hop(fresh, m, free, depth)
            if m:
                frontier, n = frontier.unionByName(fresh), n + m
        if max_depth is not None and depth >= max_depth:
            break
        depth += 1
        frontier, n = hop(frontier, n, steps, depth)
    return known(rounds.all(), rounds.n)


def _ids(graph: Graph) -> DataFrame:
    return graph.nodes.select("node_id")


def traverse(graph: Graph, start: str, kinds: Sequence[str] | None = None, max_depth: int = 3, direction: str = "outgoing", transparent: Sequence[str] = ()) -> DataFrame:
    """node_id, depth, edge_seq of all nodes within ``max_depth``, without the start. ``transparent`` kinds cost nothing."""
    steps = oriented(graph.edges, kinds, direction)
    free = steps.where(F.col("type").isin(*transparent)) if transparent else None
    paid = steps.where(~F.col("type").isin(*transparent)) if transparent else steps
    starts = graph.nodes.where(F.col("node_id") == start).select(F.col("node_id").alias("node"))
    return bfs(starts, paid, max_depth, free=free, ids=_ids(graph)).where(F.col("node") != start).select(F.col("node").alias("node_id"), "depth", "edge_seq")


def trace_data_flow(graph: Graph, start: str, max_depth: int = 3, direction: str = "outgoing") -> DataFrame:
    return traverse(graph, start, FLOW_KINDS, max_depth, direction, ("Contains",))


def render_tree(graph: Graph, page: str, max_depth: int = 5) -> DataFrame:
    return traverse(graph, page, RENDER_KINDS, max_depth)


def find_path(graph: Graph, start: str, goal: str, kinds: Sequence[str] | None = None, direction: str = "outgoing", max_depth: int | None = None) -> DataFrame | None:
    """A shortest path: step, src, dst, type, edge_seq; no rows if start is goal, None if there is none.

    It may end at an id without a node, but never passes one. Of equal paths that with the smallest
    last edges is given.
    """
    spark, schema = graph.nodes.sparkSession, "step int, src string, dst string, type string, edge_seq long"
    if start == goal:
        return spark.createDataFrame([], schema)
    steps, ids, rounds = oriented(graph.edges, kinds, direction), _ids(graph), Rounds(spark, "path")
    none = F.lit(None).cast("struct<edge_seq:long,src:string,type:string>")
    frontier, n = rounds.add(spark.range(1).select(F.lit(start).alias("node"), none.alias("via")))
    levels: list[DataFrame] = []
    while n and (max_depth is None or len(levels) < max_depth):
        at = ids.select(F.col("node_id").alias("src")).join(small(frontier.select(F.col("node").alias("src")), n), "src")
        hop = steps.join(small(at, n), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("edge_seq", "src", "type")).alias("via"))
        frontier, n = rounds.add(hop.join(small(rounds.all().select("node"), rounds.n), "node", "left_anti").select("node", "via"))
        levels.append(frontier)
        if n and not frontier.where(F.col("node") == goal).isEmpty():
            break
    else:
        return None
    out, at = [], goal
    for step in range(len(levels), 0, -1):  # a row a step of the path
        via = levels[step - 1].where(F.col("node") == at).first()["via"]
        out.append((step, via["src"], at, via["type"], via["edge_seq"]))
        at = via["src"]
    return spark.createDataFrame(out[::-1], schema)


def relevance(graph: Graph, focus: Sequence[str], max_depth: int = 3, direction: str = "outgoing") -> tuple[DataFrame, list[str]]:
    """(node_id, relevance) with 1 / (1 + distance to the nearest focus), and the ids that aren't nodes."""
    found = graph.nodes.where(F.col("node_id").isin(*focus)).select(F.col("node_id").alias("node"))
    there = {r["node"] for r in found.collect()}  # no more than were asked for
    near = bfs(found, oriented(graph.edges, None, direction), max_depth, ids=_ids(graph))
    return near.select(F.col("node").alias("node_id"), (1.0 / (1.0 + F.col("depth"))).alias("relevance")), [f for f in focus if f not in there]


def research(graph: Graph, focus: Sequence[str], max_depth: int = 3, threshold: float = 0.0, direction: str = "outgoing") -> tuple[DataFrame, DataFrame]:
    """Nodes (with relevance, most relevant first) and the edges among them."""
    scored, missing = relevance(graph, focus, max_depth, direction)
    if len(missing) == len(list(focus)):
        raise ValueError(f"no such node: {', '.join(missing)}")
    kept = settled(scored.where(F.col("relevance") >= threshold), "research")
    nodes = graph.nodes.join(kept, "node_id").orderBy(F.desc("relevance"), "node_seq")
    ends = kept.select("node_id")
    edges = graph.edges.join(ends.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ends.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return nodes, edges
