"""The graph: a node table and an edge table with typed columns for the hot properties.

It is a multigraph with open kinds and allowed dangling ends. ``kind`` is what a node or edge shows:
its foreign kind if it has one, else its known kind. Missing flags are false, a missing project
equals no given project.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODE_KINDS = (
    "ApiController Class ConfigurationFile ControllerAction CssFile ExternalType Field HtmlElement JavaScriptFile Layout Method "
    "Middleware NamedBinding PageModel Parameter PartialView Project Property RazorPage Route Service ServiceImplementation "
    "ServiceInterface TagHelperInvocation Unknown ViewComponent ViewDataKey ViewModel"
).split()
EDGE_KINDS = (
    "BindsTo BoundBy Calls Contains Covers DecoratedBy DefinesSection DependsOn DomSelectedBy Escapes Extends HandlesHttpMethod "
    "HasModel Implements Inherits InjectedInto MapsToRoute PageServedBy Produces Quotes Reads References Registers RendersComponent "
    "RendersPartial ReturnsView Unknown UrlGeneratedBy UsesLayout ViewDataReadBy ViewDataWrittenBy Writes"
).split()
#: Followed only when named: a hub of annotations connects everything to everything.
ANNOTATION_KINDS = ("DecoratedBy",)
TYPE_KINDS = ("PageModel", "ApiController", "Service", "ServiceInterface", "ServiceImplementation", "ViewModel", "Class", "Middleware", "ExternalType")
ENTRY_KINDS = ("main", "pageHandler", "controllerAction", "eventHandler", "asyncVoid", "frameworkOverride", "frameworkInterface", "middleware", "callback")
HTTP_KINDS = ("pageHandler", "controllerAction", "middleware")

THROWS = "array<struct<type:string,chain:array<string>,conditional:boolean>>"
_NODE_DDL = (
    "node_id string, node_seq long, type string, foreign_type string, name string, file_path string, line_start int, line_end int, "
    "project string, declaring_type string, full_name string, is_public boolean, is_interface boolean, is_test boolean, "
    "is_test_lifecycle boolean, is_abstract boolean, is_override boolean, is_primary_ctor boolean, body_depth int, "
    f"entry_point_kind string, model_type string, throws {THROWS}, implements_methods array<string>, boundary_catches array<string>, "
    "boundary_catches_filtered array<string>, labels array<string>, props string"
)
_EDGE_DDL = (
    "edge_seq long, src string, dst string, type string, foreign_type string, depth int, line int, guarded_by array<string>, "
    "filtered_by array<string>, via_delegate boolean, signature boolean, provenance string, value string, exception_type string, "
    "path array<string>, conditional boolean, intercepted_by array<string>, intercepted_conditionally_by array<string>, props string"
)


def _columns(ddl: str) -> list[tuple[str, str]]:
    """(name, type) of each column of a DDL string; commas inside <> don't separate."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = ddl[start:i].strip().partition(" ")
            out.append((name, kind))
            start = i + 1
    return out


NODE_COLUMNS, EDGE_COLUMNS = _columns(_NODE_DDL), _columns(_EDGE_DDL)


def ci(c: Column | str) -> Column:
    """For case-insensitive comparison."""
    return F.lower(c)


def kind() -> Column:
    return F.coalesce("foreign_type", "type")


def flag(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def prop(name: str, kind: str = "string") -> Column:
    """A property of the long tail; null if it's missing or of another type."""
    return F.try_variant_get(F.try_parse_json(F.col("props")), f"$.{name}", kind)


def _conformed(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[(F.col(n).cast(t) if n in have else F.lit(None).cast(t)).alias(n) for n, t in columns])


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    built_at: datetime | None = None
    foreign_versions: tuple[str, ...] = ()

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, **meta: Any) -> Graph:
        """Fills up missing columns; ids without a ``node_seq`` or ``edge_seq`` are numbered by id."""
        nodes, edges = _conformed(nodes, NODE_COLUMNS), _conformed(edges, EDGE_COLUMNS)
        return Graph(nodes, edges, **meta)

    @staticmethod
    def build(spark: SparkSession, nodes: Iterable[Mapping[str, Any]], edges: Iterable[Mapping[str, Any]], **meta: Any) -> Graph:
        """From small lists of dicts, in order; a node that is given again replaces the earlier one."""

        def frame(rows: list[dict], ddl: str, columns: list[tuple[str, str]]) -> DataFrame:
            return spark.createDataFrame([tuple(r.get(n) for n, _ in columns) for r in rows], ddl)

        n = [{"node_seq": i, "type": "Unknown"} | dict(r) for i, r in enumerate(nodes)]
        e = [{"edge_seq": i} | dict(r) for i, r in enumerate(edges)]
        return Graph(upsert(frame(n, _NODE_DDL, NODE_COLUMNS)), frame(e, _EDGE_DDL, EDGE_COLUMNS), **meta)

    def with_edges(self, *more: DataFrame) -> Graph:
        """Appends edges; theirs come after all that are there."""
        last = self.edges.agg(F.coalesce(F.max("edge_seq"), F.lit(-1))).first()[0]
        edges = self.edges
        for i, m in enumerate(more):
            seq = F.col("edge_seq") + F.lit(last + 1) if "edge_seq" in m.columns else F.monotonically_increasing_id() + F.lit(last + 1 + i * (1 << 40))
            edges = edges.unionByName(_conformed(m.withColumn("edge_seq", seq), EDGE_COLUMNS))
        return replace(self, edges=edges)

    def with_nodes(self, *more: DataFrame) -> Graph:
        """Upserts nodes by id: the last attributes win, the place in the order stays."""
        shift = self.nodes.agg(F.coalesce(F.max("node_seq"), F.lit(-1))).first()[0] + 1
        fresh = [_conformed(m, NODE_COLUMNS).withColumn("node_seq", F.coalesce("node_seq", F.xxhash64("node_id").bitwiseAND(F.lit((1 << 40) - 1))) + F.lit(shift)) for m in more]
        return replace(self, nodes=upsert(reduce(DataFrame.unionByName, fresh, self.nodes)))


def upsert(nodes: DataFrame) -> DataFrame:
    """One row an id: the attributes that came last at the first row's place."""
    by = Window.partitionBy("node_id")
    rows = nodes.withColumn("__last", F.row_number().over(by.orderBy(F.desc("node_seq")))).withColumn("__first", F.min("node_seq").over(by))
    return rows.where("__last = 1").withColumn("node_seq", F.col("__first")).drop("__last", "__first")


def first_by(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row a key, the first in the order."""
    rows = df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where("__k = 1").drop("__k")
