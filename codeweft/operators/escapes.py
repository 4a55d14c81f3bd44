"""Exceptions that escape to entry points, by fixed point over callers.

A fact is (method, type); conditional facts may be raised to firm ones, never back, so the loop
ends. Facts of a round travel to the callers of their method and of every interface method that it
implements. A guard that handles the type (or ``*``) stops it, a filter makes it conditional.
Of several ways to the same fact the firm one wins, then the shortest, then the smallest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import HTTP_KINDS, Graph
from ..store import BROADCAST_ROWS, Rounds, counted, fresh_path, placed, settled, small


def handles(guards: str | Column, chain: str | Column) -> Column:
    g = F.col(guards) if isinstance(guards, str) else guards
    return F.coalesce(F.array_contains(g, "*") | F.arrays_overlap(g, chain), F.lit(False))


_KEYS, _FACTS = ["method", "exception_type"], ["chain", "conditional", "depth", "path"]


def _best() -> Column:
    return F.min_by(F.struct(*_FACTS), F.struct("conditional", "depth", "path")).alias("f")


def escape_facts(graph: Graph, max_depth: int | None = None, entries: DataFrame | None = None) -> DataFrame:
    """method, exception_type, chain, conditional, depth, path (thrower first); with ``entries`` (method, entry_point_kind) of these alone."""
    found, more = _rounds(graph, max_depth).all(), []
    if entries is not None:
        # The facts are shuffled once, by method, for this join and for the choice of the best.
        found, more = found.join(entries, "method"), [F.first("entry_point_kind").alias("entry_point_kind")]
    # A firm fact over the conditional one before it.
    best = found.groupBy(*_KEYS).agg(_best(), *more)
    return best.select(*_KEYS, "f.*", *(["entry_point_kind"] if more else []))


def _rounds(graph: Graph, max_depth: int | None) -> Rounds:
    """The facts of each round, appended and never rewritten; of a method and type the last is the surest."""
    keys, facts = _KEYS, _FACTS
    best = _best()
    thrown = graph.nodes.where("throws is not null").select("node_id", F.explode("throws").alias("t"))
    thrown = thrown.select(F.col("node_id").alias("method"), F.col("t.type").alias("exception_type"), F.col("t.chain").alias("chain"), F.coalesce("t.conditional", F.lit(False)).alias("conditional"))
    thrown = thrown.withColumns({"depth": F.lit(0), "path": F.array("method")}).groupBy(*keys).agg(best).select(*keys, "f.*")
    spark = graph.nodes.sparkSession
    rounds = Rounds(spark, "facts")
    frontier, n = rounds.add(thrown)
    calls = graph.edges.where("type = 'Calls'").select(F.col("src").alias("caller"), "dst", "guarded_by", "filtered_by")
    calls = placed(calls.join(graph.nodes.select(F.col("node_id").alias("caller")), "caller", "left_semi"), "callers", "dst")
    bound, many = counted(graph.nodes.where("implements_methods is not null").select(F.col("node_id").alias("method"), F.explode("implements_methods").alias("dst")), fresh_path(spark, "bound"))
    depth = 0
    while n and (max_depth is None or depth < max_depth):
        depth += 1
        lands, m = frontier.select(F.col("method").alias("dst"), "exception_type", *facts), n
        if many:
            # What the bodies of an interface method throw becomes one fact for each type, chain and certainty before it meets the
            # calls: a guard can't tell them apart, and paths of a round have one length, so the least stays the least.
            lands = lands.drop("depth").unionByName(small(frontier, 4 * n).join(bound, "method").select("dst", "exception_type", "chain", "conditional", "path"))
            lands, m = counted(lands.groupBy("dst", "exception_type", "chain", "conditional").agg(F.min("path").alias("path")), fresh_path(spark, "lands"))
        moved = calls.join(small(lands, 4 * m), "dst").where(~handles("guarded_by", "chain"))
        moved = moved.select(
            F.col("caller").alias("method"), "exception_type", "chain", (F.col("conditional") | handles("filtered_by", "chain")).alias("conditional"), F.lit(depth).alias("depth"), F.concat("path", F.array("caller")).alias("path")
        )
        moved = moved.groupBy(*keys).agg(best).select(*keys, "f.*")
        old = rounds.all().select(F.col("method").alias("m"), F.col("exception_type").alias("e"), F.col("conditional").alias("was"))
        if 4 * m <= BROADCAST_ROWS < rounds.n:
            # Few facts move: of the old ones only those of the same keys are looked at.
            moved, k = counted(moved, fresh_path(spark, "moved"))
            if k <= BROADCAST_ROWS:
                same = F.broadcast(moved.select(F.col("method").alias("m"), F.col("exception_type").alias("e")))
                old = F.broadcast(old.join(same, ["m", "e"], "left_semi").distinct())
        else:
            old = small(old, rounds.n)
        frontier, n = rounds.add(moved.join(old, F.expr("method = m and exception_type = e and (conditional or not was)"), "left_anti"))
    return rounds


def escape_edges(graph: Graph, max_depth: int | None = None) -> DataFrame:
    """The Escapes edges: thrower, entry, type, depth, path, conditional, and which boundaries intercept them."""
    entries = graph.nodes.where("type = 'Method' and entry_point_kind is not null").select(F.col("node_id").alias("method"), "entry_point_kind")
    rows = settled(escape_facts(graph, max_depth, entries), "escapes")
    borders = graph.nodes.where("type = 'Method' and (boundary_catches is not null or boundary_catches_filtered is not null)")
    borders = borders.select(F.col("node_id").alias("border"), "boundary_catches", "boundary_catches_filtered")
    none = F.array().cast("array<string>")
    named = borders.select("border", F.explode(F.coalesce("boundary_catches", none)).alias("name"), F.lit(True).alias("firm")).unionByName(
        borders.select("border", F.explode(F.coalesce("boundary_catches_filtered", none)).alias("name"), F.lit(False).alias("firm"))
    )
    # Boundaries are matched with each distinct chain of types once, not with each escape, then given to the escapes by chain.
    http = F.col("entry_point_kind").isin(*HTTP_KINDS)
    chains = rows.where(http).select("chain").distinct().select("chain", F.explode(F.array_distinct(F.concat("chain", F.array(F.lit("*"))))).alias("name"))
    hits, n = counted(chains.join(named, "name").groupBy("chain", "border").agg(F.bool_or("firm").alias("firm")), fresh_path(rows.sparkSession, "hits"))
    lists = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("border"))))
    hits = small(hits.groupBy("chain").agg(lists(F.col("firm")).alias("firm"), lists(~F.col("firm")).alias("maybe")).withColumn("http", F.lit(True)), n)
    others = lambda c: F.filter(c, lambda b: b != F.col("method"))
    some = lambda c: F.when(F.size(others(c)) > 0, others(c))
    return rows.withColumn("http", http).join(hits, ["chain", "http"], "left").select(
        F.col("path")[0].alias("src"), F.col("method").alias("dst"), F.lit("Escapes").alias("type"), "exception_type", "depth", "path", "conditional", some("firm").alias("intercepted_by"), some("maybe").alias("intercepted_conditionally_by")
    )
