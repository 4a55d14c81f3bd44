"""Command line: build, build-solution, build-lua, query, body, body-diff, research.

Exit codes: 0 done, 1 refused or (body-diff) different, 2 a wrong call or a missing file. Fact tables are
Parquet, a folder with a table each; graphs are saved JSON or the native folder form.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import CONTRACT, Tools, report
from .build import LUA_FACTS, SOLUTION_FACTS, build_lua, build_solution
from .model import Graph
from .operators import lookup, traverse
from .operators.bodies import body_diff
from .sources.codec import FormatError, load_graph, read_tables, save_graph, write_tables
from .sources.files import output_folder

UNCOVERED_SHOWN = 200


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codeweft")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        return commands.add_parser(name, help=text)

    for name, text in (("build", "a graph of node and edge tables"), ("build-solution", "a graph of fact tables"), ("build-lua", "a graph of Lua fact tables")):
        c = command(name, text)
        c.add_argument("folder")
        c.add_argument("-o", "--output", default="graphs/graph.json", help="a .json document or a folder for the native form")
        c.add_argument("--no-analyses", action="store_true", help="without escapes and coverage")
        c.add_argument("--attribute-policy", help="a JSON file; its sections replace those of the default")
    c = command("query", "one question to a graph; of several modes the first of mismatches, escapes, uncovered, deep, id, type, name counts")
    c.add_argument("graph")
    for option in ("--id", "--type", "--name", "--project", "--entry-kind", "--exception"):
        c.add_argument(option)
    for option in ("--neighbors", "--render-tree", "--context", "--trace", "--covering-tests", "--covered-methods", "--uncovered", "--mismatches", "--escapes", "--json"):
        c.add_argument(option, action="store_true")
    c.add_argument("--depth", type=int, default=3)
    c.add_argument("--deep", type=int, default=0)
    c.add_argument("--direction", default="outgoing", choices=traverse.DIRECTIONS)
    c = command("body", "the blocks of one method's body")
    c.add_argument("folder")
    c.add_argument("--method", required=True)
    c = command("body-diff", "are two bodies the same; exit 0 equivalent, 1 different, 2 error")
    c.add_argument("folder")
    c.add_argument("--method", required=True)
    c.add_argument("--against")
    c.add_argument("--baseline", help="a folder of body tables saved earlier: the left side")
    c = command("research", "the nodes near some, and the edges among them, as JSON lines")
    c.add_argument("graph")
    c.add_argument("--focus", nargs="+", required=True)
    c.add_argument("--depth", type=int, default=3)
    c.add_argument("--threshold", type=float, default=0.0)
    c.add_argument("-o", "--output", default="graphs/research")
    return top


def _tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(str(p)) for n in names for p in [next((q for q in (Path(folder) / n, Path(folder) / f"{n}.parquet") if q.exists()), None)] if p is not None}


def _graph(spark: SparkSession, path: str) -> Graph:
    if not Path(path).exists():
        raise FileNotFoundError(path)
    return read_tables(spark, path) if (Path(path) / "nodes").exists() else load_graph(spark, path)[0]


def _build(spark: SparkSession, args: argparse.Namespace) -> int:
    if not Path(args.folder).is_dir():
        raise FileNotFoundError(args.folder)
    if args.command == "build":
        tools = Tools(spark)
        tables = _tables(spark, args.folder, ["nodes", "edges"])
        graph = tools.graphs.require(tools.build_graph(tables["nodes"], tables["edges"], args.folder, not args.no_analyses))
    elif args.command == "build-solution":
        policy = json.loads(Path(args.attribute_policy).read_text()) if args.attribute_policy else None
        graph = build_solution(spark, _tables(spark, args.folder, SOLUTION_FACTS), policy, not args.no_analyses)
    else:
        graph, counters = build_lua(spark, _tables(spark, args.folder, LUA_FACTS))
        print(counters.toJSON().first())
    _, advice = output_folder(Path(args.output).parent)
    (save_graph if args.output.endswith(".json") else write_tables)(graph, args.output)
    if advice:
        print(advice)
    return 0


def _query(spark: SparkSession, args: argparse.Namespace) -> int:
    g = _graph(spark, args.graph)

    def show(mode: str, rows: DataFrame, cap: int | None = None) -> int:
        print(report(rows, {"mode": mode}, args.json, cap))
        return 0

    if args.mismatches:
        return show("mismatches", lookup.server_to_script(g))
    if args.escapes:
        lookup.require_escapes(g)
        return show("escapes", lookup.escapes_report(g, args.entry_kind, args.exception, args.project))
    if args.uncovered:
        return show("uncovered", lookup.summary(lookup.uncovered_methods(g, args.project)).orderBy("node_id"), UNCOVERED_SHOWN)
    if args.deep > 0:
        return show("deep", lookup.deep_methods(g, args.deep, args.project).select("node_id", "name", "project", "body_depth"))
    if args.id is not None:
        lookup.require_node(g, args.id)
        if args.covering_tests:
            return show("coveringTests", lookup.covering_tests(g, args.id).select("node_id", "name", "depth"))
        if args.covered_methods:
            return show("coveredMethods", lookup.covered_methods(g, args.id).select("node_id", "name", "depth"))
        if args.render_tree:
            return show("renderTree", traverse.render_tree(g, args.id).orderBy("depth", "edge_seq"))
        if args.context:
            return show("context", lookup.page_context(g, args.id))
        if args.trace:
            return show("trace", traverse.trace_data_flow(g, args.id, args.depth, args.direction).orderBy("depth", "edge_seq"))
        if args.neighbors:
            return show("neighbors", lookup.node_detail(g, args.id).where("direction = 'out'").orderBy("edge_seq"))
        return show("node", lookup.node(g, args.id))
    if args.type is not None:
        rows = lookup.nodes_of_kind(g, lookup.resolve_kind(g, args.type), args.name)
        return show("type", lookup.summary(lookup.in_project(rows, args.project)).orderBy("node_id"))
    if args.name is not None:
        return show("name", lookup.summary(lookup.nodes_by_name(g, args.name)).orderBy("node_id"))
    counts = g.nodes.agg(F.count("*").alias("nodes")).withColumn("edges", F.lit(g.edges.count()))
    return show("summary", counts)


def _body(spark: SparkSession, args: argparse.Namespace) -> int:
    tables = _tables(spark, args.folder, ["blocks", "regions", "depths"])
    of = lambda t, body, side: t.where(F.col("body") == body).withColumn("body", F.lit(side))
    if tables["blocks"].where(F.col("body") == args.method).isEmpty():
        print(f"no body of {args.method}", file=sys.stderr)
        return 2
    if args.command == "body":
        print(report(Tools(spark).method_body_graph(tables["blocks"], args.method)))
        return 0
    if (args.against is None) == (args.baseline is None):
        print("give exactly one of --against and --baseline", file=sys.stderr)
        return 2
    left, name = (tables, args.against) if args.against is not None else (_tables(spark, args.baseline, ["blocks", "regions", "depths"]), args.method)
    if "blocks" not in left or left["blocks"].where(F.col("body") == name).isEmpty():
        print(f"no body of {name} to compare with", file=sys.stderr)
        return 2
    both = {t: of(left[t], name, "left").unionByName(of(tables[t], args.method, "right")) for t in ("blocks", "regions", "depths")}
    row = body_diff(spark.createDataFrame([(0, "left", "right")], "pair int, left string, right string"), both["blocks"], both["regions"], both["depths"]).drop("pair")
    print(row.toJSON().first())
    return 0 if row.first()["equivalent"] else 1


def _research(spark: SparkSession, args: argparse.Namespace) -> int:
    from .sources.codec import research_document

    output_folder(Path(args.output).parent)
    document = research_document(*traverse.research(_graph(spark, args.graph), args.focus, args.depth, args.threshold))
    document.coalesce(1).write.mode("overwrite").text(args.output)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    spark = spark or SparkSession.builder.appName("codeweft").getOrCreate()
    run = {"query": _query, "body": _body, "body-diff": _body, "research": _research}.get(args.command, _build)
    try:
        return run(spark, args)
    except FileNotFoundError as e:
        print(f"not found: {e}", file=sys.stderr)
        return 2
    except (lookup.Refusal, FormatError, ValueError) as e:
        if getattr(args, "json", False):
            print(json.dumps({"contract": CONTRACT, "mode": "error", "error": str(e)}))
        else:
            print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
