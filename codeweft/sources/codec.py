"""Saved graphs: JSON documents with a format version, and Parquet as the native form."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import EDGE_COLUMNS, EDGE_KINDS, NODE_COLUMNS, NODE_KINDS, Graph, ci, kind
from ..store import settled

CURRENT = (1, 2)
#: Files that a task writes side by side; every known kind has one.
MOST_OPEN = 64

#: Properties with a column of their own: the saved name of each.
NODE_PROPERTIES = {
    "project": "project", "declaring_type": "declaringType", "full_name": "fullName", "is_public": "isPublic", "is_interface": "isInterface", "is_test": "isTest",
    "is_test_lifecycle": "isTestLifecycle", "is_abstract": "isAbstract", "is_override": "isOverride", "is_primary_ctor": "isPrimaryConstructor", "body_depth": "bodyDepth",
    "entry_point_kind": "entryPointKind", "model_type": "modelType", "implements_methods": "implementsMethods", "boundary_catches": "boundaryCatches", "boundary_catches_filtered": "boundaryCatchesFiltered",
}
EDGE_PROPERTIES = {
    "depth": "depth", "line": "line", "guarded_by": "guardedBy", "filtered_by": "filteredBy", "via_delegate": "viaDelegate", "signature": "signature", "provenance": "provenance", "value": "value",
    "exception_type": "exceptionType", "path": "path", "conditional": "conditional", "intercepted_by": "interceptedBy", "intercepted_conditionally_by": "interceptedConditionallyBy",
}


class FormatError(ValueError):
    pass


@dataclass(frozen=True)
class Assessment:
    version: tuple[int, int] | None
    supported: bool
    caveat: str | None = None


def parse_version(text: str) -> tuple[int, int]:
    if not isinstance(text, str) or not re.fullmatch(r"[0-9]+\.[0-9]+", text):
        raise FormatError(f"not a format version: {text!r}")
    major, minor = text.split(".")
    return int(major), int(minor)


def assess(text: str | None) -> Assessment:
    """Unstamped files load with a caveat, newer majors don't load, older majors and newer minors load with one."""
    if text is None:
        return Assessment(None, True, "the file has no format version; it was written before versions were")
    major, minor = version = parse_version(text)
    own = ".".join(map(str, CURRENT))
    if major > CURRENT[0]:
        return Assessment(version, False, f"format {text} is newer than {own}")
    if major < CURRENT[0]:
        return Assessment(version, True, f"format {text} is older than {own}: some facts may be missing")
    return Assessment(version, True, f"format {text} is newer than {own}: some facts may not be understood" if minor > CURRENT[1] else None)


def _decoded(name: Column, known: list[str]) -> tuple[Column, Column]:
    """Known kind in its own spelling, else Unknown, with the foreign name kept."""
    spelled = F.create_map(*[F.lit(x) for k in known for x in (k.lower(), k)])[F.lower(name)]
    return F.coalesce(spelled, F.lit("Unknown")), F.when(spelled.isNull(), name)


_NODE = "struct<id:string,type:string,name:string,filePath:string,lineStart:int,lineEnd:int,properties:variant,labels:array<string>>"
_EDGE = "struct<fromId:string,toId:string,type:string,properties:variant>"
_HEAD = "formatVersion:string,builtAt:string,foreignFormatVersions:array<string>"
#: Lines of their own in what ``save_graph`` writes: the ends of a first line and the last, and what stands between nodes and edges.
_NODES_BEGIN, _EDGES_BEGIN, _END = ', "nodes": [', '], "edges": [', "]}"


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0 on), value of all files of a folder in the order of their names. Each task numbers its own; what comes before it is counted."""
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    rows = settled(spark.read.text(path).select(file.alias("file"), block.alias("block"), F.monotonically_increasing_id().alias("at"), "value"), "lines")
    # A row a block of a file.
    blocks = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(blocks.withColumn("before", before).drop("n")), ["file", "block"]).select((F.col("before") + F.col("at") - F.col("first")).alias("line"), "value")


def _documents(spark: SparkSession, path: str) -> tuple[Any, DataFrame, DataFrame]:
    """The head, the nodes (node_seq, n) and the edges (edge_seq, e) of a saved document. Lines of ``save_graph`` are read in all tasks, other documents whole."""
    value = F.col("value")
    head = spark.read.text(path).where(F.startswith(value, F.lit('{"formatVersion": ')) & F.endswith(value, F.lit(_NODES_BEGIN))).first()
    if head is None:
        raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<{_HEAD},nodes:array<{_NODE}>,edges:array<{_EDGE}>>").alias("g")).select("g.*")
        return raw.select("formatVersion", "builtAt", "foreignFormatVersions").first(), raw.select(F.posexplode("nodes").alias("node_seq", "n")), raw.select(F.posexplode("edges").alias("edge_seq", "e"))
    head = {"builtAt": None, "foreignFormatVersions": None} | json.loads(head["value"] + _END)
    lines = _placed_lines(spark, path)
    middle = lines.where(value == _EDGES_BEGIN).first()["line"]
    item = lambda kind: F.from_json(F.regexp_replace("value", "^,", ""), kind)
    nodes = lines.where((F.col("line") > 0) & (F.col("line") < middle)).select((F.col("line") - 1).alias("node_seq"), item(_NODE).alias("n"))
    edges = lines.where((F.col("line") > middle) & (value != _END)).select((F.col("line") - middle - 1).alias("edge_seq"), item(_EDGE).alias("e"))
    return head, nodes, edges


def load_graph(spark: SparkSession, path: str) -> tuple[Graph, Assessment]:
    """A saved JSON document; refuses a newer major version."""
    head, n, e = _documents(spark, path)
    if head is None:
        raise FormatError(f"nothing at {path}")
    found = assess(head["formatVersion"])
    if not found.supported:
        raise FormatError(found.caveat)

    def own(alias: str, names: dict[str, str], columns: list[tuple[str, str]]) -> list[Column]:
        kinds = dict(columns)
        return [F.try_variant_get(F.col(f"{alias}.properties"), f"$.{saved}", kinds[c]).alias(c) for c, saved in names.items()]

    known, foreign = _decoded(F.col("n.type"), NODE_KINDS)
    nodes = n.select(
        F.col("n.id").alias("node_id"), F.col("node_seq").cast("long"), known.alias("type"), foreign.alias("foreign_type"), F.col("n.name").alias("name"), F.col("n.filePath").alias("file_path"),
        F.col("n.lineStart").alias("line_start"), F.col("n.lineEnd").alias("line_end"), F.col("n.labels").alias("labels"), F.to_json("n.properties").alias("props"), *own("n", NODE_PROPERTIES, NODE_COLUMNS),
    )
    known, foreign = _decoded(F.col("e.type"), EDGE_KINDS)
    edges = e.select(
        F.col("edge_seq").cast("long"), F.col("e.fromId").alias("src"), F.col("e.toId").alias("dst"), known.alias("type"), foreign.alias("foreign_type"), F.to_json("e.properties").alias("props"), *own("e", EDGE_PROPERTIES, EDGE_COLUMNS)
    )
    versions = set(head["foreignFormatVersions"] or [])
    if found.version and found.version > CURRENT:
        versions.add(head["formatVersion"])
    built = datetime.fromisoformat(head["builtAt"].replace("Z", "+00:00")) if head["builtAt"] else None
    return Graph.of(nodes, edges, built_at=built, foreign_versions=tuple(sorted(versions))), found


def _saved_properties(names: dict[str, str]) -> Column:
    """The columns over what ``props`` held: a column that is null leaves the property as it was."""
    own = F.to_json(F.struct(*[F.col(c).alias(s) for c, s in names.items()]))
    as_map = lambda c: F.coalesce(F.from_json(c, "map<string,variant>"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    old = F.map_filter(as_map(F.col("props")), lambda k, v: ~F.map_contains_key(as_map(own), k))
    return F.map_concat(old, as_map(own))


def graph_lines(graph: Graph) -> DataFrame:
    """``value``: the JSON document, in order; a line of its own for each node and edge, so no task holds more than a range of them."""
    node = F.struct(
        F.col("node_id").alias("id"), kind().alias("type"), "name", F.col("file_path").alias("filePath"), F.col("line_start").alias("lineStart"), F.col("line_end").alias("lineEnd"), _saved_properties(NODE_PROPERTIES).alias("properties"), "labels"
    )
    edge = F.struct(F.col("src").alias("fromId"), F.col("dst").alias("toId"), kind().alias("type"), _saved_properties(EDGE_PROPERTIES).alias("properties"))
    head: dict[str, Any] = {"formatVersion": ".".join(map(str, CURRENT))}
    if graph.built_at:
        head["builtAt"] = graph.built_at.astimezone(UTC).isoformat()
    if graph.foreign_versions:
        head["foreignFormatVersions"] = list(graph.foreign_versions)
    spark, order = graph.nodes.sparkSession, ["part", "s", "j", "tie"]
    lines = lambda df, seq, body, part: df.select(F.lit(part).alias("part"), F.coalesce(seq, F.lit(-(1 << 63))).alias("s"), F.to_json(body).alias("j"))
    rows = settled(lines(graph.nodes, "node_seq", node, 1).unionByName(lines(graph.edges, "edge_seq", edge, 3)).withColumn("tie", F.monotonically_increasing_id()), "lines")
    # The first of a part has no comma before it.
    least = rows.groupBy("part").agg(F.min("s").alias("s"))
    first = rows.join(F.broadcast(least), ["part", "s"]).groupBy("part").agg(F.min(F.struct("s", "j", "tie")).alias("first"))
    rows = rows.join(F.broadcast(first), "part").withColumn("value", F.when(F.struct("s", "j", "tie") == F.col("first"), F.col("j")).otherwise(F.concat(F.lit(","), "j")))
    marks = spark.createDataFrame([(0, 0, "", 0, json.dumps(head)[:-1] + _NODES_BEGIN), (2, 0, "", 0, _EDGES_BEGIN), (4, 0, "", 0, _END)], "part int, s long, j string, tie long, value string")
    return rows.select(*order, "value").unionByName(marks).orderBy(*order).select("value")


def save_graph(graph: Graph, path: str) -> None:
    """A folder of files that are the JSON document one after the other, in the order of their names."""
    graph_lines(graph).write.mode("overwrite").text(path)


def write_tables(graph: Graph, path: str) -> None:
    """The native form; edges by kind, so that traversals of some kinds read only those.

    A task keeps a file open for each kind, so its rows aren't sorted by kind; beyond ``MOST_OPEN`` kinds the rest is.
    """
    spark, writers = graph.nodes.sparkSession, "spark.sql.maxConcurrentOutputFileWriters"
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    before = spark.conf.get(writers)
    spark.conf.set(writers, MOST_OPEN)
    try:
        graph.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")
    finally:
        spark.conf.set(writers, before)


def read_tables(spark: SparkSession, path: str) -> Graph:
    return Graph.of(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def foreign_data(graph: Graph) -> DataFrame:
    """What a graph holds that this version has no kind for: of, kind, n."""
    part = lambda df, of: df.where("foreign_type is not null").groupBy(ci("foreign_type").alias("k")).agg(F.min("foreign_type").alias("kind"), F.count("*").alias("n")).select(F.lit(of).alias("of"), "kind", "n")
    return part(graph.nodes, "node").unionByName(part(graph.edges, "edge"))


def research_document(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """JSON lines of a selection: nodes from the most relevant down, then the edges among them."""
    n = nodes.select(F.lit(0).alias("part"), (-F.col("relevance")).alias("r"), F.col("node_seq").alias("s"), F.to_json(F.struct("node_id", kind().alias("type"), "name", "relevance")).alias("value"))
    e = edges.select(F.lit(1).alias("part"), F.lit(0.0).alias("r"), F.col("edge_seq").alias("s"), F.to_json(F.struct("src", "dst", kind().alias("type"))).alias("value"))
    return n.unionByName(e).orderBy("part", "r", "s").select("value")


def research_of_ids(graph: Graph, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """A selection by ids alone: each is fully relevant."""
    nodes = graph.nodes.where(F.col("node_id").isin(*ids)).withColumn("relevance", F.lit(1.0))
    return nodes, graph.edges.where(F.col("src").isin(*ids) & F.col("dst").isin(*ids))
