"""Filters, point look-ups, one-hop joins, reports and their guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import EDGE_KINDS, ENTRY_KINDS, NODE_KINDS, Graph, ci, first_by, flag, kind


class Refusal(ValueError):
    """The graph can't answer this question; not the same as an empty answer."""


# Guards


def require_node(graph: Graph, node_id: str) -> None:
    if graph.nodes.where(F.col("node_id") == node_id).isEmpty():
        raise Refusal(f"no such node: {node_id}")


def require_tests(graph: Graph) -> None:
    if graph.nodes.where((F.col("type") == "Method") & flag("is_test")).isEmpty():
        raise Refusal("the graph has no test methods, so nothing is known of coverage")


def require_escapes(graph: Graph) -> None:
    if graph.edges.where("type = 'Escapes'").isEmpty() and graph.nodes.where(F.col("entry_point_kind").isNotNull() | F.col("throws").isNotNull()).isEmpty():
        raise Refusal("the graph was built without exception analysis")


def require_entry_kind(name: str | None) -> None:
    if name is not None and name not in ENTRY_KINDS:
        raise Refusal(f"entry kind must be one of {', '.join(ENTRY_KINDS)}: {name}")


def require_one(**given) -> None:
    if sum(v is not None for v in given.values()) != 1:
        raise Refusal(f"give exactly one of {', '.join(given)}")


def require_any(**given) -> None:
    if all(v is None for v in given.values()):
        raise Refusal(f"give at least one of {', '.join(given)}")


def foreign_kinds(graph: Graph) -> tuple[list[str], list[str]]:
    """Foreign node and edge kinds, one spelling each: a handful of names."""

    def names(df: DataFrame, seq: str) -> list[str]:
        rows = df.where("foreign_type is not null").groupBy(ci("foreign_type").alias("k")).agg(F.min_by("foreign_type", seq).alias("name"))
        return sorted(r["name"] for r in rows.collect())

    return names(graph.nodes, "node_seq"), names(graph.edges, "edge_seq")


def resolve_kind(graph: Graph, name: str, of: str = "node") -> str:
    """The kind as the graph spells it; refuses one that neither the vocabulary nor this graph has."""
    known = NODE_KINDS if of == "node" else EDGE_KINDS
    foreign = foreign_kinds(graph)[0 if of == "node" else 1]
    for k in (*known, *foreign):
        if k.lower() == name.lower():
            return k
    raise Refusal(f"unknown kind {name}; known: {', '.join(known)}; in this graph: {', '.join(foreign) or 'none'}")


# Filters


def node(graph: Graph, node_id: str) -> DataFrame:
    return graph.nodes.where(F.col("node_id") == node_id)


def nodes_of_kind(graph: Graph, name: str, contains: str | None = None) -> DataFrame:
    rows = graph.nodes.where(ci(kind()) == name.lower())
    return named(rows, contains) if contains else rows


def named(rows: DataFrame, contains: str) -> DataFrame:
    """Case-insensitive substring of the name; no wildcards."""
    return rows.where(F.contains(ci("name"), F.lit(contains.lower())))


def nodes_by_name(graph: Graph, contains: str) -> DataFrame:
    return named(graph.nodes, contains)


def nodes_with_label(graph: Graph, label: str) -> DataFrame:
    return graph.nodes.where(F.array_contains("labels", label))


def in_project(rows: DataFrame, project: str | None, column: str = "project") -> DataFrame:
    return rows if project is None else rows.where(ci(column) == project.lower())


def deep_methods(graph: Graph, least: int, project: str | None = None) -> DataFrame:
    rows = graph.nodes.where((F.col("type") == "Method") & (F.coalesce("body_depth", F.lit(0)) >= least))
    return in_project(rows, project).orderBy(F.desc(F.coalesce("body_depth", F.lit(0))), "node_seq")


def uncovered_methods(graph: Graph, project: str | None = None) -> DataFrame:
    require_tests(graph)
    rows = graph.nodes.where((F.col("type") == "Method") & ~flag("is_test") & ~flag("is_abstract"))
    covered = graph.edges.where("type = 'Covers'").select(F.col("dst").alias("node_id"))
    return in_project(rows, project).join(covered, "node_id", "left_anti")


# One hop


def neighbours(graph: Graph, node_id: str, kinds: Sequence[str]) -> DataFrame:
    hop = graph.edges.where((F.col("src") == node_id) & F.col("type").isin(*kinds)).select(F.col("dst").alias("node_id"), "edge_seq", F.col("type").alias("edge_type"))
    return hop.join(graph.nodes, "node_id")


def predecessors(graph: Graph, node_id: str, kinds: Sequence[str]) -> DataFrame:
    hop = graph.edges.where((F.col("dst") == node_id) & F.col("type").isin(*kinds)).select(F.col("src").alias("node_id"), "edge_seq", F.col("type").alias("edge_type"))
    return hop.join(graph.nodes, "node_id")


def node_detail(graph: Graph, node_id: str) -> DataFrame:
    """direction, other, name, edge_type of every edge at a node; dangling ends have a null name."""
    show = F.coalesce("foreign_type", "type").alias("edge_type")
    out = graph.edges.where(F.col("src") == node_id).select(F.lit("out").alias("direction"), F.col("dst").alias("other"), show, "edge_seq")
    back = graph.edges.where(F.col("dst") == node_id).select(F.lit("in").alias("direction"), F.col("src").alias("other"), show, "edge_seq")
    return out.unionByName(back).join(graph.nodes.select(F.col("node_id").alias("other"), "name"), "other", "left")


def covering_tests(graph: Graph, method: str) -> DataFrame:
    require_tests(graph)
    hop = graph.edges.where((F.col("dst") == method) & (F.col("type") == "Covers")).select(F.col("src").alias("node_id"), "depth", "edge_seq")
    return hop.join(graph.nodes, "node_id").orderBy("depth", "edge_seq")


def covered_methods(graph: Graph, test: str) -> DataFrame:
    require_tests(graph)
    hop = graph.edges.where((F.col("src") == test) & (F.col("type") == "Covers")).select(F.col("dst").alias("node_id"), "depth", "edge_seq")
    return hop.join(graph.nodes, "node_id").orderBy("depth", "edge_seq")


def quoted_symbols(graph: Graph, project: str | None = None, safe: bool = False, same_project: bool = False) -> DataFrame:
    """src, dst, value, provenance, line of names quoted in text; ``nameof`` and own-project ones only if asked for."""
    quotes = graph.edges.where("type = 'Quotes'").withColumn("provenance", F.coalesce("provenance", F.lit("literal")))
    if not safe:
        quotes = quotes.where("provenance <> 'nameof'")
    ends = lambda x: graph.nodes.select(F.col("node_id").alias(x), F.col("project").alias(f"{x}_project"), F.col("name").alias(f"{x}_name"))
    rows = in_project(quotes.join(ends("src"), "src"), project, "src_project").join(ends("dst"), "dst")
    if not same_project:
        rows = rows.where(~ci("src_project").eqNullSafe(ci("dst_project")))
    return rows.select("src", "dst", F.coalesce("value", "dst_name").alias("value"), "provenance", "line", "edge_seq")


def escapes_report(graph: Graph, entry_kind: str | None = None, exception: str | None = None, project: str | None = None, entry: str | None = None) -> DataFrame:
    """thrower, entry, exception_type, depth, conditional, entry_kind, project; by depth, entry and type."""
    require_entry_kind(entry_kind)
    rows = graph.edges.where("type = 'Escapes'").select(F.col("src").alias("thrower"), F.col("dst").alias("entry"), "exception_type", "depth", flag("conditional").alias("conditional"), "path", "intercepted_by", "intercepted_conditionally_by")
    if exception is not None:
        rows = rows.where(F.contains(ci("exception_type"), F.lit(exception.lower())))
    if entry is not None:
        rows = rows.where(F.col("entry") == entry)
    rows = rows.join(graph.nodes.select(F.col("node_id").alias("entry"), F.col("entry_point_kind").alias("entry_kind"), "project"), "entry")
    if entry_kind is not None:
        rows = rows.where(F.col("entry_kind") == entry_kind)
    rows = in_project(rows, project).join(graph.nodes.select(F.col("node_id").alias("thrower")), "thrower", "left_semi")
    return rows.orderBy("depth", "entry", "exception_type")


def server_to_script(graph: Graph) -> DataFrame:
    """script, server, edge_type: what on the server feeds a script by name alone."""
    scripts = graph.nodes.where("type = 'JavaScriptFile'").select(F.col("node_id").alias("script"), F.col("name").alias("script_name"))
    hop = graph.edges.where(F.col("type").isin("ViewDataReadBy", "Reads", "DomSelectedBy")).select(F.col("src").alias("server"), F.col("dst").alias("script"), F.col("type").alias("edge_type"), "edge_seq")
    return hop.join(scripts, "script").join(graph.nodes.select(F.col("node_id").alias("server"), F.col("name").alias("server_name")), "server")


def page_context(graph: Graph, page: str) -> DataFrame:
    """One row (none for what isn't a page): page, model, view_model, services."""
    own = graph.nodes.where((F.col("node_id") == page) & F.col("type").isin("RazorPage", "PartialView")).select(F.col("node_id").alias("page"), "model_type")
    models = graph.nodes.where("type = 'PageModel'").select(F.col("node_id").alias("dst"), "name")
    served = graph.edges.where((F.col("src") == page) & (F.col("type") == "PageServedBy")).join(models, "dst")
    model = served.groupBy(F.col("src").alias("page")).agg(F.min_by(F.struct("dst", "name"), "edge_seq").alias("m")).select("page", F.col("m.dst").alias("into"), F.col("m.name").alias("model"))
    injected = graph.edges.where("type = 'InjectedInto'").select(F.col("src").alias("node_id"), F.col("dst").alias("into"))
    services = model.select("page", "into").join(injected, "into").join(graph.nodes.select("node_id", "name"), "node_id").groupBy("page").agg(F.sort_array(F.collect_list("name")).alias("services"))
    views = graph.nodes.where(F.col("type").isin("ViewModel", "Class")).select("name", "type", "node_seq")
    # The page is one row, so the substring join meets each view model once.
    fits = F.broadcast(own).join(views, F.contains(views["name"], own["model_type"])).select("page", "name", F.struct(F.col("type") != "ViewModel", F.col("node_seq")).alias("order"))
    view = fits.groupBy("page").agg(F.min_by("name", "order").alias("view_model"))
    rows = own.join(model, "page", "left").join(services, "page", "left").join(view, "page", "left")
    return rows.select("page", "model", "view_model", F.coalesce("services", F.array().cast("array<string>")).alias("services"))


# Reports


def census(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy(kind().alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def edge_census(graph: Graph) -> DataFrame:
    return graph.edges.groupBy(kind().alias("kind")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def nodes_per_project(graph: Graph) -> DataFrame:
    return graph.nodes.where("project is not null").groupBy(ci("project").alias("key")).agg(F.min("project").alias("project"), F.count("*").alias("n")).select("project", "n")


def unique_names(graph: Graph) -> DataFrame:
    """name, node_id of names that one node alone has; projects, parameters and names with a leading dot don't count."""
    rows = graph.nodes.where(~F.col("type").isin("Project", "Parameter") & ~F.col("name").startswith("."))
    return rows.groupBy("name").agg(F.count("*").alias("n"), F.min("node_id").alias("node_id")).where("n = 1").select("name", "node_id")


def test_projects(graph: Graph) -> DataFrame:
    return graph.nodes.where(flag("is_test") & F.col("project").isNotNull()).select(ci("project").alias("project")).distinct()


def callers(graph: Graph) -> DataFrame:
    return graph.edges.where("type = 'Calls'").groupBy("dst").agg(F.sort_array(F.collect_set("src")).alias("callers"))


def page(rows: DataFrame, limit: int = 50) -> tuple[DataFrame, dict]:
    """At most ``limit`` rows (one at least) and what was left out."""
    total = rows.count()
    shown = min(total, max(1, limit))
    return rows.limit(max(1, limit)), {"returned": shown, "totalMatches": total, "truncated": shown < total}


def summary(rows: DataFrame) -> DataFrame:
    return rows.select("node_id", kind().alias("kind"), "name", "project", "file_path", "line_start")


def detail(rows: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """All of a node that a front end shows. ``written``: node_id, written_since; shown where true, else null: never as proof of no change."""
    since = rows.select("node_id").withColumn("file_written_since", F.lit(None).cast("boolean")) if written is None else written.select("node_id", F.when(F.col("written_since"), F.lit(True)).alias("file_written_since"))
    shown = rows.join(since, "node_id", "left")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    return shown.select("node_id", kind().alias("kind"), "name", "file_path", "line_start", "line_end", "file_written_since", "props", some("labels").alias("labels"))


def first_declaration(rows: DataFrame, key: str = "full_name") -> DataFrame:
    return first_by(rows, [key], "node_seq", "node_id")
