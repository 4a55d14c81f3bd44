"""What keeps queries in bounds on large tables: each would fail on code that gathers, repeats or multiplies rows."""

import json
from pathlib import Path

import pytest

from codeweft.model import Graph
from codeweft.operators import bodies, client, coverage, declarations, escapes
from codeweft.plans import pages as page_plans
from codeweft.sources import codec
from codeweft.store import placed, settled
from test_full_coverage import brute, small


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bodies_are_compared_in_batches(spark):
    ddl = "body string, ordinal int, kind string, operations array<string>, calls array<string>, condition string, when_true int, when_false int, falls_to int, region int"
    own = lambda b, op, *calls: [(b, 0, "Entry", [], [], None, None, None, 1, 0), (b, 1, "Block", [op], list(calls), None, None, None, 2, 0), (b, 2, "Exit", [], [], None, None, None, None, 0)]
    names = [f"b{i}" for i in range(40)]
    blocks = spark.createDataFrame([row for i, b in enumerate(names) for row in own(b, f"op{i % 2}", *["m", "n"][: i % 3])], ddl).repartition(7)
    regions = spark.createDataFrame([(b, 0, None, "Root", None) for b in names], "body string, id int, parent int, kind string, exception_type string")
    pairs = spark.createDataFrame([(i, f"b{i}", f"b{j}") for i, j in zip(range(40), [*range(1, 40), 99], strict=True)], "pair int, left string, right string")
    found = bodies.body_diff(pairs, blocks, regions, spark.createDataFrame([(b, 2) for b in names], "body string, depth int"))
    plan = plan_of(found)
    assert "ArrowEvalPython" in plan and "FlatMapCoGroups" not in plan
    rows = {r["pair"]: r for r in found.collect()}
    assert len(rows) == 40 and not any(r["equivalent"] for r in rows.values())
    for i in range(39):
        left, right = ["m", "n"][: i % 3], ["m", "n"][: (i + 1) % 3]
        assert rows[i]["calls_only_left"] == [c for c in left if c not in right] and rows[i]["calls_only_right"] == [c for c in right if c not in left]
        assert rows[i]["differences"] == [f"L1/R1: operations ['op{i % 2}'] <> ['op{(i + 1) % 2}']"]
    # A body that isn't there: one difference, not a failed task.
    assert rows[39]["differences"] == ["L0/RNone: no entry"] and rows[39]["depth_right"] is None


def test_pages_are_scanned_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(page_plans, "settled", lambda df, name: made.append(name) or settled(df, name))
    data = "/root/testdata/sf0.001"
    if not Path(data).exists():
        pytest.skip("no test tables")
    found = page_plans.query.__globals__["QUERIES"]["page_partials"](spark, data)
    assert made == ["pages"] and "ArrowEvalPython" not in plan_of(found)


def test_views_are_sought_once_for_each_name_and_folder(spark, monkeypatch):
    from codeweft.functions import paths

    asked = []
    own = paths._candidates
    monkeypatch.setattr(paths, "_candidates", lambda wanted, templates: asked.append(wanted.count()) or own(wanted, templates))
    facts = spark.createDataFrame([(f"p{i}", f"Pages/{i % 2}/P{i}.cshtml", [("_A", i, True), ("_B", 1, False)]) for i in range(50)], "id string, path string, partials array<struct<name:string,line:int,is_tag:boolean>>")
    templates = spark.createDataFrame([("a0", "Pages/0/_A.cshtml"), ("a", "Pages/Shared/_A.cshtml")], "id string, path string")
    edges, stubs = client.partial_edges(facts, templates)
    rows = {(r["src"], r["line"], r["dst"]) for r in edges.collect()}
    assert rows == {(f"p{i}", i, "a" if i % 2 else "a0") for i in range(50)} | {(f"p{i}", 1, "partial:_B") for i in range(50)} and [r["name"] for r in stubs.collect()] == ["_B"]
    assert asked[0] == 4


def test_names_of_many_rows_are_joined_apart(spark, monkeypatch):
    nodes = spark.createDataFrame([(f"t{i}", i, "Class", f"N{i}") for i in range(5)], "node_id string, node_seq long, type string, full_name string")
    facts = spark.createDataFrame([(f"m{i}", None, False, ["Out", "N1", f"N{i % 5}", "Gone"]) for i in range(60)], "id string, owner string, signature boolean, names array<string>")
    want = {(f"m{i}", f"t{j}") for i in range(60) for j in (1, i % 5)}
    monkeypatch.setattr(declarations, "HOT_ROWS", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = declarations.reference_edges(facts, nodes)
        assert "BroadcastHashJoin" in plan_of(found)
        assert {(r["src"], r["dst"]) for r in found.collect()} == want
        usages = spark.createDataFrame([(f"m{i}", ["Out", None, "N1"][i % 3], "n", "lib", "method", i, "src", "[]") for i in range(90)], "id string, attribute string, name string, assembly string, target string, line int, source string, args string")
        assert sorted(r["dst"] for r in declarations.attribute_edges(usages, nodes)[0].where("dst is not null").collect()) == ["ext:Out"] * 30 + ["t1"] * 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_saved_graph_is_lines_in_order(spark, tmp_path):
    n = 500
    nodes = spark.range(n).selectExpr("concat('n', id) AS node_id", f"{n} - id AS node_seq", "'Class' AS type", "'two\nlines' AS name").repartition(5)
    edges = spark.range(n).selectExpr("id div 2 AS edge_seq", "concat('n', id) AS src", "'n0' AS dst", "'Calls' AS type").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        codec.save_graph(Graph.of(nodes, edges), str(tmp_path / "g"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "g").glob("part-*"))
    text = "".join(f.read_text() for f in files)
    assert len(files) > 1 and len(text.splitlines()) == 2 * n + 3
    whole = json.loads(text)
    assert [x["id"] for x in whole["nodes"]] == [f"n{i}" for i in range(n - 1, -1, -1)] and len(whole["edges"]) == n
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "g.json").write_text(json.dumps(whole))
    for folder in ("g", "one"):
        back = codec.load_graph(spark, str(tmp_path / folder))[0]
        assert [(r["node_seq"], r["node_id"], r["name"]) for r in back.nodes.orderBy("node_seq").collect()] == [(i, f"n{n - 1 - i}", "two\nlines") for i in range(n)]
        assert [(r["edge_seq"], r["src"]) for r in back.edges.orderBy("edge_seq").collect()] == [(i, x["fromId"]) for i, x in enumerate(whole["edges"])]
    empty = Graph.of(nodes.limit(0), edges.limit(0))
    codec.save_graph(empty, str(tmp_path / "e"))
    assert codec.load_graph(spark, str(tmp_path / "e"))[0].nodes.count() == 0


def test_edges_are_written_by_kind_without_a_sort(spark, tmp_path):
    g = Graph.build(spark, [{"node_id": "a"}], [{"src": "a", "dst": "a", "type": t} for t in ("Calls", "Reads", "Calls")])
    codec.write_tables(g, str(tmp_path / "t"))
    executions = spark._jsparkSession.sharedState().statusStore().executionsList()
    assert "Sort" not in executions.last().physicalPlanDescription()
    assert sorted(r["type"] for r in codec.read_tables(spark, str(tmp_path / "t")).edges.collect()) == ["Calls", "Calls", "Reads"]


def test_facts_of_bodies_meet_before_the_calls(spark, monkeypatch):
    chain = ["E", "Base"]
    nodes = [{"node_id": f"s{i:02}", "type": "Method", "throws": [{"type": "E", "chain": chain, "conditional": i % 2 == 0}], "implements_methods": ["p", "q"]} for i in range(20)]
    nodes += [{"node_id": x, "type": "Method"} for x in "pq"] + [{"node_id": f"m{i}", "type": "Method", "entry_point_kind": "main"} for i in range(4)]
    edges = [{"src": "m0", "dst": "p", "type": "Calls"}, {"src": "m1", "dst": "q", "type": "Calls", "filtered_by": ["Base"]}, {"src": "m2", "dst": "q", "type": "Calls", "guarded_by": ["E"]}, {"src": "m3", "dst": "m1", "type": "Calls"}]
    sizes = {}
    monkeypatch.setattr(escapes, "placed", lambda df, name, *keys: sizes.setdefault(name, df.count()) and placed(df, name, *keys))
    rows = {(r["src"], r["dst"], r["depth"], tuple(r["path"]), r["conditional"]) for r in escapes.escape_edges(Graph.build(spark, nodes, edges)).collect()}
    assert rows == {("s01", "m0", 1, ("s01", "m0"), False), ("s00", "m1", 1, ("s00", "m1"), True), ("s00", "m3", 2, ("s00", "m1", "m3"), True)}
    assert sizes["callers"] == len(edges)


def test_placed_rows_stay_where_they_are(spark):
    rows = placed(spark.range(100).selectExpr("concat('k', id % 10) AS k", "id"), "rows", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = rows.join(spark.range(10).selectExpr("concat('k', id) AS k", "id AS n"), "k")
        assert plan_of(joined).count("Exchange hashpartitioning") == 1 and joined.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("rows")]


def test_steps_of_calls_are_placed_once_and_one_walk_reads_the_graph(spark, monkeypatch):
    nodes, edges = small()
    g = Graph.build(spark, nodes, [{"src": a, "dst": b, "type": t} for a, t, b in edges])
    made = []
    monkeypatch.setattr(coverage, "placed", lambda df, name, *keys: made.append((name, keys)) or placed(df, name, *keys))
    want = brute(nodes, edges)
    assert {(r["src"], r["dst"], r["depth"]) for r in coverage.coverage(g).collect()} == {(a, b, d) for (a, b), d in want.items()} and made == [("call-steps", ("src",))]
    assert {(r["dst"], r["depth"]) for r in coverage.coverage(g, test="t2").collect()} == {(b, d) for (a, b), d in want.items() if a == "t2"} and len(made) == 1


def test_few_facts_meet_few_of_the_old_ones(spark, monkeypatch):
    monkeypatch.setattr(escapes, "BROADCAST_ROWS", 12)
    thrown = [{"type": "E", "chain": ["E"], "conditional": False}]
    nodes = [{"node_id": f"m{i:02}", "type": "Method", "entry_point_kind": "main", "throws": thrown if i >= 15 or i == 3 else None} for i in range(30)]
    edges = [{"src": f"m{i:02}", "dst": f"m{i + 1:02}", "type": "Calls", "filtered_by": ["E"] if i == 9 else None} for i in range(15)] + [{"src": "m05", "dst": "m00", "type": "Calls"}]
    rows = {(r["dst"], r["src"], r["depth"], r["conditional"]) for r in escapes.escape_edges(Graph.build(spark, nodes, edges)).collect()}
    # m03 throws for m00 to m02 and, round the circle, for m05 and m04, all for sure; m06 to m09 have m15's alone, past the filter.
    want = {(f"m{i:02}", f"m{i:02}", 0, False) for i in [3, *range(15, 30)]} | {(f"m{i:02}", "m15", 15 - i, i <= 9) for i in range(6, 15)}
    want |= {("m02", "m03", 1, False), ("m01", "m03", 2, False), ("m00", "m03", 3, False), ("m05", "m03", 4, False), ("m04", "m03", 5, False)}
    assert rows == want


def test_consumers_are_made_distinct_before_spellings_are_sorted(spark):
    from codeweft.operators import visibility

    g = Graph.build(spark, [{"node_id": x, "project": p} for x, p in (("a", "Shop"), ("b", "SHOP"), ("c", "Other"), ("d", None), ("t", "Shop"))], [{"src": x, "dst": "t", "type": "Calls"} for x in "aabbccd"] + [{"src": "a", "dst": "gone", "type": "Calls"}])
    found = visibility.consumers(g)
    assert "SortAggregate" not in plan_of(found) and [tuple(r) for r in found.collect()] == [("t", ["Other", "SHOP"])]
