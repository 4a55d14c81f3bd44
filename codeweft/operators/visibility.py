"""Public nodes that nothing outside their project needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import TYPE_KINDS, Graph, ci, flag, kind
from ..store import settled
from .lookup import in_project, test_projects
from .traverse import bfs


def _grown(required: DataFrame, more: DataFrame) -> tuple[DataFrame, bool]:
    fresh = settled(more.select("id").distinct().join(required, "id", "left_anti"), "required")
    return (required, False) if fresh.isEmpty() else (settled(required.unionByName(fresh), "required"), True)


def consumers(graph: Graph) -> DataFrame:
    """node_id, consumed_by: the projects that any edge but coverage comes from, its own among them."""
    edges = graph.edges.where("type <> 'Covers'").select("src", "dst")
    own = graph.nodes.where("project is not null").select("node_id", "project")
    rows = edges.join(own.select(F.col("node_id").alias("src"), "project"), "src").join(own.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    # Made distinct by hash: the least spelling as an aggregate would sort every edge. Of a node's few projects the first spelling of each is kept.
    rows = rows.select(F.col("dst").alias("node_id"), "project").distinct().groupBy("node_id").agg(F.sort_array(F.collect_list("project")).alias("p"))
    low = F.transform("p", F.lower)
    return rows.select("node_id", F.filter("p", lambda x, i: F.array_position(low, F.lower(x)) == i + 1).alias("consumed_by"))


def excess_visibility(graph: Graph, project: str | None = None, include_tests: bool = False, include_members: bool = False) -> DataFrame:
    """node_id, kind, name, consumed_by of nodes that could be less visible.

    Needed is what another, non-test project uses, the type that holds it, what it exposes in its
    signature, and what members that stay public expose; the last is worked out anew from each
    round's report, as a member can enter it when its type leaves.
    """
    nodes = settled(graph.nodes.select("node_id", kind().alias("kind"), "type", "name", "project", flag("is_public").alias("pub"), (flag("is_interface") | (F.col("type") == "ServiceInterface")).alias("iface"), (flag("is_override") | flag("is_primary_ctor")).alias("fixed")), "visible")
    edges = graph.edges.select("src", "dst", "type", "edge_seq", flag("signature").alias("signature"))
    owner = settled(edges.where("type = 'Contains'").groupBy(F.col("dst").alias("child")).agg(F.max_by("src", "edge_seq").alias("owner")), "owners")
    of = nodes.select("node_id", "project")
    crossing = edges.where("type <> 'Covers'").join(of.select(F.col("node_id").alias("src"), ci("project").alias("from")), "src").join(of.select(F.col("node_id").alias("dst"), ci("project").alias("to")), "dst").where(F.col("from") != F.col("to"))
    if not include_tests:
        crossing = crossing.join(test_projects(graph).select(F.col("project").alias("from")), "from", "left_anti")
    seeds = crossing.select(F.col("dst").alias("id")).distinct()
    seeds = seeds.unionByName(seeds.join(owner, seeds["id"] == owner["child"]).select(F.col("owner").alias("id"))).distinct()
    required = settled(seeds, "required")
    shape = nodes.where(F.col("type").isin("Property", "Field")).select(F.col("node_id").alias("src"), F.lit(True).alias("shape"))
    exposes = settled(edges.where("type = 'References'").join(shape, "src", "left").where(F.col("signature") | F.coalesce("shape", F.lit(False))).select("src", "dst").distinct(), "exposes")
    pulls = settled(exposes.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(owner.select(F.col("child").alias("id"), F.col("owner").alias("to"))), "pulls")
    is_type = F.col("type").isin(*TYPE_KINDS)
    while True:
        grew = True
        while grew:
            required, grew = _grown(required, required.join(pulls, "id").select(F.col("to").alias("id")))
        candidates = in_project(nodes.where("pub"), project).join(required.select(F.col("id").alias("node_id")), "node_id", "left_anti")
        if not include_members:
            candidates = candidates.where(is_type | (F.col("type") == "Method"))
        candidates = settled(candidates.withColumn("is_type", is_type), "candidates")
        held = owner.join(nodes.select(F.col("node_id").alias("owner"), F.col("pub").alias("o_pub"), F.col("iface").alias("o_iface"), F.lit(True).alias("o_there")), "owner", "left")
        held = held.join(candidates.where("is_type").select(F.col("node_id").alias("owner"), F.lit(True).alias("o_reported")), "owner", "left").withColumnRenamed("child", "node_id")
        members = candidates.where("not is_type and not fixed").join(held, "node_id", "left")
        members = members.where("owner is null or (o_reported is null and (o_there is null or (o_pub and not o_iface)))").select(*candidates.columns)
        report = settled(candidates.where("is_type").unionByName(members), "report")
        # What stays public: itself and all that hold it, at any depth, public and not reported. Walked from the outermost
        # down, so owners in a circle are never reached.
        left = settled(nodes.where("pub").select("node_id").join(report.select("node_id"), "node_id", "left_anti"), "public")
        own = settled(left.join(owner, left["node_id"] == owner["child"], "left").select("node_id", "owner"), "owned")
        inner = own.where("owner is not null").select(F.col("owner").alias("src"), F.col("node_id").alias("dst"), F.lit(0).cast("long").alias("edge_seq"))
        closed = bfs(own.where("owner is null").select(F.col("node_id").alias("node")), inner, None).select(F.col("node").alias("node_id"))
        pinned = exposes.join(closed.select(F.col("node_id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        required, grew = _grown(required, pinned)
        if not grew:
            break
    none = F.array().cast("array<string>")
    return report.join(consumers(graph), "node_id", "left").select("node_id", "kind", "name", F.coalesce("consumed_by", none).alias("consumed_by")).orderBy("kind", "name")
