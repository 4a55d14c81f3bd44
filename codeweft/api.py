"""The tools: named questions to a registry of graphs, with envelopes as front ends show them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph, kind
from .operators import lookup, traverse
from .operators.bodies import body_diff
from .operators.coverage import coverage
from .operators.escapes import escape_edges
from .operators.visibility import excess_visibility
from .sources.codec import foreign_data, load_graph, research_document, save_graph
from .sources.registry import Registry

CONTRACT = 1


class Tools:
    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.graphs = spark, Registry()

    # Graphs

    def load_graph(self, path: str, graph_id: str | None = None) -> dict[str, Any]:
        graph, found = load_graph(self.spark, path)
        return {"graphId": self.graphs.add(graph, path, graph_id), "caveat": found.caveat}

    def save_graph(self, path: str, graph_id: str | None = None) -> None:
        save_graph(self.graphs.require(graph_id), path)

    def build_graph(self, nodes: DataFrame, edges: DataFrame, source: str, analyses: bool = True) -> str:
        """From node and edge tables; with the analyses that a build makes once: escapes, then coverage."""
        graph = Graph.of(nodes, edges)
        if analyses:
            graph = graph.with_edges(escape_edges(graph))
            graph = graph.with_edges(coverage(graph))
        return self.graphs.add(graph, source)

    def list_graphs(self) -> list[dict[str, str]]:
        return [{"graphId": e.graph_id, "source": e.source, "loadedAt": e.loaded_at.isoformat()} for e in self.graphs.list()]

    def drop_graph(self, graph_id: str) -> bool:
        return self.graphs.remove(graph_id)

    def graph_summary(self, graph_id: str | None = None) -> dict[str, DataFrame]:
        g = self.graphs.require(graph_id)
        return {"nodes": lookup.census(g), "edges": lookup.edge_census(g), "foreign": foreign_data(g)}

    def server_info(self) -> dict[str, Any]:
        from . import __version__

        return {"version": __version__, "contract": CONTRACT, "spark": self.spark.version, "graphs": len(self.graphs.list())}

    # Navigation

    def find_nodes(self, kind_name: str | None = None, name: str | None = None, limit: int = 50, graph_id: str | None = None) -> tuple[DataFrame, dict]:
        lookup.require_any(kind=kind_name, name=name)
        g = self.graphs.require(graph_id)
        rows = lookup.nodes_of_kind(g, lookup.resolve_kind(g, kind_name), name) if kind_name else lookup.nodes_by_name(g, name)
        return lookup.page(lookup.summary(rows).orderBy("node_id"), limit)

    def get_node(self, node_id: str, graph_id: str | None = None) -> tuple[DataFrame, DataFrame]:
        g = self.graphs.require(graph_id)
        lookup.require_node(g, node_id)
        return lookup.node(g, node_id), lookup.node_detail(g, node_id)

    def trace_data_flow(self, node_id: str, max_depth: int = 3, direction: str = "outgoing", graph_id: str | None = None) -> DataFrame:
        g = self.graphs.require(graph_id)
        lookup.require_node(g, node_id)
        return traverse.trace_data_flow(g, node_id, max_depth, direction).join(g.nodes.select("node_id", kind().alias("kind"), "name"), "node_id")

    def find_path(self, start: str, goal: str, kinds: Sequence[str] | None = None, direction: str = "outgoing", graph_id: str | None = None) -> DataFrame | None:
        g = self.graphs.require(graph_id)
        lookup.require_node(g, start)
        return traverse.find_path(g, start, goal, [lookup.resolve_kind(g, k, "edge") for k in kinds] if kinds else None, direction)

    def research(self, focus: Sequence[str], max_depth: int = 3, threshold: float = 0.0, direction: str = "outgoing", graph_id: str | None = None) -> DataFrame:
        return research_document(*traverse.research(self.graphs.require(graph_id), focus, max_depth, threshold, direction))

    # Coverage, bodies, exceptions, visibility, names

    def covering_tests(self, method: str, graph_id: str | None = None) -> tuple[DataFrame, str | None]:
        """The tests, and a caveat if there are none."""
        found = lookup.covering_tests(self.graphs.require(graph_id), method)
        return found, "no test reaches it by calls that the graph has; reflection and configuration are not seen" if found.isEmpty() else None

    def covered_methods(self, test: str, graph_id: str | None = None) -> DataFrame:
        return lookup.covered_methods(self.graphs.require(graph_id), test)

    def uncovered_methods(self, project: str | None = None, limit: int = 50, graph_id: str | None = None) -> tuple[DataFrame, dict]:
        return lookup.page(lookup.uncovered_methods(self.graphs.require(graph_id), project).orderBy("node_id"), limit)

    def deep_methods(self, least: int, project: str | None = None, limit: int = 50, graph_id: str | None = None) -> tuple[DataFrame, dict]:
        return lookup.page(lookup.deep_methods(self.graphs.require(graph_id), least, project), limit)

    def method_body_graph(self, blocks: DataFrame, body: str) -> DataFrame:
        return blocks.where(F.col("body") == body).orderBy("ordinal")

    def method_body_diff(self, pairs: DataFrame, blocks: DataFrame, regions: DataFrame, depths: DataFrame) -> DataFrame:
        return body_diff(pairs, blocks, regions, depths)

    def exception_escapes(self, entry_kind: str | None = None, exception: str | None = None, project: str | None = None, entry: str | None = None, limit: int = 50, graph_id: str | None = None) -> tuple[DataFrame, dict]:
        g = self.graphs.require(graph_id)
        lookup.require_escapes(g)
        return lookup.page(lookup.escapes_report(g, entry_kind, exception, project, entry), limit)

    def excess_visibility(self, project: str | None = None, include_tests: bool = False, include_members: bool = False, limit: int = 50, graph_id: str | None = None) -> tuple[DataFrame, dict]:
        return lookup.page(excess_visibility(self.graphs.require(graph_id), project, include_tests, include_members), limit)

    def quoted_symbols(self, project: str | None = None, safe: bool = False, same_project: bool = False, limit: int = 50, graph_id: str | None = None) -> tuple[DataFrame, dict]:
        return lookup.page(lookup.quoted_symbols(self.graphs.require(graph_id), project, safe, same_project).orderBy("edge_seq"), limit)

    # Pages

    def render_tree(self, page: str, graph_id: str | None = None) -> DataFrame:
        return traverse.render_tree(self.graphs.require(graph_id), page)

    def page_context(self, page: str, graph_id: str | None = None) -> DataFrame:
        return lookup.page_context(self.graphs.require(graph_id), page)

    def find_server_to_js_mismatches(self, graph_id: str | None = None) -> DataFrame:
        return lookup.server_to_script(self.graphs.require(graph_id))


def report(rows: DataFrame, envelope: dict | None = None, as_json: bool = True, text_limit: int | None = None) -> str:
    """What a front end prints of rows: a contract-numbered envelope of all of them, or lines. ``text_limit`` cuts
    the lines alone, and says how many were left out."""
    if as_json:
        data = [json.loads(x) for x in rows.toJSON().collect()]
        return json.dumps({"contract": CONTRACT, **(envelope or {}), "rows": data}, ensure_ascii=False)
    shown = rows if text_limit is None else rows.limit(text_limit)
    lines = ["  ".join(str(v) for v in json.loads(x).values()) for x in shown.toJSON().collect()]
    left = 0 if text_limit is None or len(lines) < text_limit else rows.count() - len(lines)
    return "\n".join([*lines, f"... and {left} more"] if left else lines)
