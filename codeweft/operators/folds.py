"""Facts folded into edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import Graph, flag
from .lookup import unique_names

MIN_QUOTE = 3


def _common(guards: Column) -> Column:
    """The guards that all sites share; ``*`` stands for every guard, so only sites without it limit."""
    known = F.filter(F.transform(guards, lambda g: F.coalesce(g, F.array().cast("array<string>"))), lambda g: ~F.array_contains(g, "*"))
    met = F.aggregate(F.slice(known, 2, F.greatest(F.size(known), F.lit(1))), F.get(known, F.lit(0)), F.array_intersect)
    return F.when(F.size(known) == 0, F.array(F.lit("*"))).otherwise(F.array_sort(met))


def call_edges(sites: DataFrame, nodes: DataFrame) -> DataFrame:
    """``sites``: src, dst, guarded_by, filtered_by, via_delegate; one Calls edge for each pair of known ends."""
    ids = nodes.select("node_id")
    sites = sites.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    # Equal guard sets of a pair are one: a list in this aggregate has as many entries as there are kinds of guard.
    none = F.array().cast("array<string>")
    sets = sites.select("src", "dst", F.array_sort(F.coalesce("guarded_by", none)).alias("g"), F.array_sort(F.coalesce("filtered_by", none)).alias("f"), flag("via_delegate").alias("v"))
    rows = sets.groupBy("src", "dst").agg(F.collect_set("g").alias("g"), F.collect_set("f").alias("f"), F.bool_and("v").alias("via_delegate"))
    some = lambda c: F.when(F.size(c) > 0, c)
    return rows.select("src", "dst", F.lit("Calls").alias("type"), some(_common(F.col("g"))).alias("guarded_by"), some(_common(F.col("f"))).alias("filtered_by"), "via_delegate")


def access_edges(accesses: DataFrame) -> DataFrame:
    """``accesses``: src, dst, is_read, is_write; Reads if any site reads, Writes if any writes."""
    rows = accesses.groupBy("src", "dst").agg(F.bool_or("is_read").alias("r"), F.bool_or("is_write").alias("w"))
    kinds = F.array_compact(F.array(F.when(F.col("r"), F.lit("Reads")), F.when(F.col("w"), F.lit("Writes"))))
    return rows.select("src", "dst", F.explode(kinds).alias("type"))


def thrown_types(throws: DataFrame) -> DataFrame:
    """``throws``: method, type, conditional; a row a type, firm before conditional."""
    return throws.groupBy("method", "type").agg(F.bool_and(flag("conditional")).alias("conditional"))


def quote_edges(graph: Graph, quotes: DataFrame) -> DataFrame:
    """``quotes``: src, value, provenance, line; those that name one node alone, but not themselves, once for each provenance."""
    rows = quotes.where(F.length("value") >= MIN_QUOTE).join(unique_names(graph).withColumnRenamed("name", "value"), "value").where(F.col("src") != F.col("node_id"))
    rows = rows.groupBy("src", F.col("node_id").alias("dst"), "provenance").agg(F.min_by(F.struct("value", "line"), "line").alias("q"))
    return rows.select("src", "dst", F.lit("Quotes").alias("type"), F.col("q.value").alias("value"), "provenance", F.col("q.line").alias("line"))


def callback_stamps(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes whose id is in ``targets`` (node_id) become callbacks, unless they're tests or have an entry kind."""
    hit = targets.select("node_id").distinct().withColumn("__hit", F.lit(True))
    stamp = F.when(F.col("__hit") & ~flag("is_test") & ~flag("is_test_lifecycle"), F.lit("callback"))
    return nodes.join(hit, "node_id", "left").withColumn("entry_point_kind", F.coalesce("entry_point_kind", stamp)).drop("__hit")
