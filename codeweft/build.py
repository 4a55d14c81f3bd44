"""Composing graphs: every emitter for which fact tables are given, then the analyses, in the order of a build."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph
from .operators import binding, client, declarations, folds, lua
from .operators.coverage import coverage
from .operators.escapes import escape_edges
from .store import settled

#: What each pass reads; a table that isn't given leaves out what is made of it.
SOLUTION_FACTS = "projects project_references symbols methods members parameters attributes registrations injections references extensions implements call_sites accesses throws quotes callbacks pages assets view_calls actions shape_mentions placements".split()
LUA_FACTS = "modules functions references calls bindings external catalogue instance_methods".split()


def _checked(facts: Mapping[str, DataFrame], known: list[str]) -> None:
    odd = sorted(set(facts) - set(known))
    if odd:
        raise ValueError(f"unknown fact tables: {', '.join(odd)}; known: {', '.join(known)}")


def build_solution(spark: SparkSession, facts: Mapping[str, DataFrame], policy: Mapping[str, Any] | None = None, analyses: bool = True) -> Graph:
    """A graph of declared symbols, usages, pages, scripts, views and shapes. ``facts``: SOLUTION_FACTS by name."""
    _checked(facts, SOLUTION_FACTS)
    policy, has = declarations.merged_policy(policy), facts.get
    none = Graph.build(spark, [], [])
    graph = none

    def nodes(*more: DataFrame | None) -> None:
        nonlocal graph
        some = [m for m in more if m is not None]
        graph = graph.with_nodes(*some) if some else graph

    def edges(*more: DataFrame | None) -> None:
        nonlocal graph
        some = [m for m in more if m is not None]
        graph = graph.with_edges(*some) if some else graph

    if has("symbols") is not None:
        nodes(declarations.type_nodes(facts["symbols"]))
    for table in ("methods", "members"):
        if has(table) is not None:
            rows = declarations.with_roles(facts[table].withColumn("declaring_type", F.col("owner")), policy) if table == "methods" else facts[table]
            own, contains = declarations.member_nodes(rows)
            nodes(own)
            edges(contains)
    if has("parameters") is not None:
        own, contains = declarations.decorated_parameters(facts["parameters"])
        nodes(own)
        edges(contains)
    if has("throws") is not None:
        thrown = facts["throws"].groupBy("method", "type").agg(F.first("chain").alias("chain"), F.bool_and("conditional").alias("conditional"))
        thrown = thrown.groupBy(F.col("method").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("type", "chain", "conditional"))).alias("found"))
        graph = Graph.of(graph.nodes.join(thrown, "node_id", "left").withColumn("throws", F.coalesce("throws", "found")), graph.edges)
    if has("attributes") is not None:
        decorated, outside = declarations.attribute_edges(facts["attributes"], graph.nodes, policy)
        nodes(outside)
        edges(decorated)
    for table, emit in (
        ("symbols", declarations.inheritance_edges), ("references", declarations.reference_edges), ("extensions", declarations.extension_edges), ("implements", declarations.implements_edges),
        ("registrations", declarations.register_edges), ("injections", declarations.injection_edges),
    ):
        if has(table) is not None and (table != "symbols" or "base_type" in facts["symbols"].columns):
            edges(emit(facts[table], graph.nodes))
    if has("call_sites") is not None:
        edges(folds.call_edges(facts["call_sites"], graph.nodes))
    if has("accesses") is not None:
        edges(folds.access_edges(facts["accesses"]))
    if has("quotes") is not None:
        edges(folds.quote_edges(graph, facts["quotes"]))
    if has("callbacks") is not None:
        graph = Graph.of(folds.callback_stamps(graph.nodes, facts["callbacks"]), graph.edges)
    if has("pages") is not None:
        pages = settled(client.page_facts(facts["pages"]), "pages")
        nodes(client.page_nodes(pages))
        partials, stubs = client.partial_edges(pages, facts["pages"].select("id", "path"))
        nodes(stubs)
        helpers, rendered = client.tag_helpers(pages, graph.nodes)
        edges(declarations.page_links(pages.withColumn("page_model", F.lit(None).cast("string")), graph.nodes), partials, rendered)
        nodes(helpers)
        if has("assets") is not None:
            inline = client.inline_scripts(pages).select("id", "path", "text", "page")
            assets = facts["assets"].select("id", "path", "text", *([c for c in ("vendor_reason",) if c in facts["assets"].columns]))
            every = assets.unionByName(inline.drop("page"), allowMissingColumns=True)
            every = every if "vendor_reason" in every.columns else every.withColumn("vendor_reason", F.lit(None).cast("string"))
            nodes(client.asset_nodes(every))
            scripts = client.script_facts(every.where("vendor_reason is null"))
            loads = client.loaded_scripts(pages, facts["assets"]).unionByName(inline.select("page", F.col("id").alias("script"))).distinct()
            edges(client.coupling_edges(client.composed_scopes(pages, partials), loads, scripts), client.api_edges(scripts, graph.nodes))
        if has("view_calls") is not None:
            returned, _ = binding.view_edges(facts["view_calls"], facts["pages"])
            edges(returned, *([binding.helper_renders(returned, graph.edges, facts["actions"])] if has("actions") is not None else []))
    if has("shape_mentions") is not None:
        mentions = facts["shape_mentions"].select("name", "by", "is_alternate", "in_test", "line")
        if has("placements") is not None:
            nodes(binding.placement_nodes(facts["placements"]))
            mentions = mentions.unionByName(binding.placement_mentions(facts["placements"]))
        shapes = binding.shape_nodes(mentions)
        nodes(shapes)
        edges(binding.produce_edges(mentions), *([binding.placement_edges(facts["placements"])] if has("placements") is not None else []))
        if has("pages") is not None:
            templates = facts["pages"].select("id", "path", F.lit(None).cast("string").alias("project"))
            edges(binding.bound_edges(binding.shape_bindings(shapes.withColumn("projects", F.array().cast("array<string>")), templates), templates))
    if has("projects") is not None:
        nodes(declarations.project_nodes(facts["projects"], graph.nodes))
        if has("project_references") is not None:
            edges(declarations.project_references(facts["project_references"], facts["projects"]))
    if analyses:
        edges(escape_edges(graph))
        edges(coverage(graph))
    return graph


def build_lua(spark: SparkSession, facts: Mapping[str, DataFrame]) -> tuple[Graph, DataFrame]:
    """A graph of modules, their functions, requires and calls, those to a host's API included; and the report of the build."""
    _checked(facts, LUA_FACTS)
    modules, functions = facts["modules"], facts["functions"]
    references = lua.resolved_references(facts["references"], modules, facts["external"])
    calls = lua.resolved_calls(facts["calls"], facts["bindings"], functions, facts["catalogue"], facts["instance_methods"])
    mod = lambda c: F.concat(F.lit("mod:"), c)
    own = lua.function_nodes(functions)
    required = references.where("outcome = 'inGraph'").select(mod("module").alias("src"), mod("target").alias("dst"), F.lit("DependsOn").alias("type"), "line")
    called = calls.where("target is not null").select(mod("module").alias("src"), F.col("target").alias("dst"), F.lit("Calls").alias("type"), "line")
    contains = own.select(F.col("declaring_type").alias("src"), F.col("node_id").alias("dst"), F.lit("Contains").alias("type"))
    graph = Graph.build(spark, [], []).with_nodes(lua.module_nodes(modules), own, lua.external_nodes(calls)).with_edges(contains, required, called)
    return graph, lua.build_counters(modules, functions, references)


def merged(*graphs: Graph) -> Graph:
    """One graph of several, in their order; a node that comes again takes the later attributes."""
    return reduce(lambda a, b: a.with_nodes(b.nodes).with_edges(b.edges), graphs)
