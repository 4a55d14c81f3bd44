"""Golden graphs: traversals, coverage, escapes, visibility, look-ups."""

import pytest

from codeweft.model import Graph
from codeweft.operators import lookup, traverse
from codeweft.operators.coverage import coverage
from codeweft.operators.escapes import escape_edges
from codeweft.operators.visibility import consumers, excess_visibility


def build(spark, edges, nodes=None, ghosts=(), **props):
    ids = sorted({x for a, _, b in edges for x in (a, b)} - set(ghosts)) if nodes is None else nodes
    rows = [{"node_id": n, "type": "Method", "name": n} if isinstance(n, str) else n for n in ids]
    return Graph.build(spark, rows, [{"src": a, "dst": b, "type": t} | props.get(f"{a}_{b}", {}) for a, t, b in edges])


def reached(rows):
    return {r["node_id"]: r["depth"] for r in rows.collect()}


def test_traverse(spark):
    g = build(spark, [("a", "Calls", "b"), ("a", "Inherits", "x"), ("b", "Calls", "c"), ("c", "Calls", "d"), ("d", "Calls", "a")])
    assert reached(traverse.traverse(g, "a", ["Calls"], 2)) == {"b": 1, "c": 2}
    assert reached(traverse.traverse(g, "a", ["Calls"], 10)) == {"b": 1, "c": 2, "d": 3}
    assert reached(traverse.traverse(g, "c", None, 1, "both")) == {"b": 1, "d": 1}
    assert reached(traverse.traverse(g, "a", ["Inherits"], 3)) == {"x": 1}
    with pytest.raises(ValueError):
        traverse.traverse(g, "a", None, 1, "sideways")


def test_transparent_edges_cost_nothing(spark):
    g = build(spark, [("k", "Contains", "m"), ("m", "Calls", "callee"), ("callee", "Calls", "deeper")])
    assert reached(traverse.traverse(g, "k", ["Contains", "Calls"], 1, transparent=["Contains"])) == {"m": 0, "callee": 1}
    assert reached(traverse.traverse(g, "k", ["Contains", "Calls"], 1)) == {"m": 1}
    g = build(spark, [("s", "Calls", "a"), ("s", "Contains", "c"), ("a", "Calls", "y"), ("c", "Calls", "y"), ("y", "Calls", "z")])
    assert reached(traverse.trace_data_flow(g, "s", 2)) == {"a": 1, "c": 0, "y": 1, "z": 2}


def test_paths(spark):
    g = build(spark, [("a", "Calls", "b"), ("b", "Calls", "c"), ("t1", "DecoratedBy", "attr"), ("t2", "DecoratedBy", "attr"), ("a", "Calls", "ghost"), ("ghost", "Calls", "far")], ghosts=["ghost"])
    steps = [(r["src"], r["dst"]) for r in traverse.find_path(g, "a", "c").orderBy("step").collect()]
    assert steps == [("a", "b"), ("b", "c")]
    assert traverse.find_path(g, "a", "a").count() == 0
    assert traverse.find_path(g, "c", "a") is None
    assert traverse.find_path(g, "c", "a", direction="incoming").count() == 2
    assert traverse.find_path(g, "t1", "t2", direction="both") is None
    assert traverse.find_path(g, "t1", "attr", ["DecoratedBy"]).count() == 1
    assert traverse.find_path(g, "a", "ghost").count() == 1
    assert traverse.find_path(g, "a", "far") is None


def test_relevance(spark):
    g = build(spark, [("A", "Calls", "B"), ("B", "Calls", "C"), ("D", "Calls", "C")])
    rows, missing = traverse.relevance(g, ["A", "D", "Nope"])
    assert {r["node_id"]: r["relevance"] for r in rows.collect()} == {"A": 1.0, "D": 1.0, "B": 0.5, "C": 0.5}
    assert missing == ["Nope"]
    nodes, edges = traverse.research(g, ["A"], threshold=0.5)
    assert [r["node_id"] for r in nodes.collect()] == ["A", "B"] and edges.count() == 1
    with pytest.raises(ValueError):
        traverse.research(g, ["Nope"])


PAGE = [
    {"node_id": "page", "type": "RazorPage", "name": "Catalog", "model_type": "CatalogViewModel"},
    {"node_id": "pm", "type": "PageModel", "name": "CatalogModel"},
    {"node_id": "vm", "type": "ViewModel", "name": "CatalogViewModel"},
    {"node_id": "svc", "type": "ServiceInterface", "name": "ICatalogService"},
    {"node_id": "js", "type": "JavaScriptFile", "name": "catalog.js"},
    {"node_id": "layout", "type": "PartialView", "name": "_Layout"},
    {"node_id": "card", "type": "PartialView", "name": "_Card"},
]
PAGE_EDGES = [("page", "PageServedBy", "pm"), ("pm", "ReturnsView", "page"), ("svc", "InjectedInto", "pm"), ("page", "UsesLayout", "layout"), ("layout", "RendersPartial", "card"), ("page", "ViewDataReadBy", "js")]


def test_pages(spark):
    g = build(spark, PAGE_EDGES, PAGE)
    assert set(reached(traverse.render_tree(g, "page"))) == {"layout", "card"}
    row = lookup.page_context(g, "page").collect()
    assert [tuple(r) for r in row] == [("page", "CatalogModel", None, ["ICatalogService"])] or row[0]["model"] == "CatalogModel"
    assert row[0]["services"] == ["ICatalogService"] and row[0]["view_model"] == "CatalogViewModel"
    assert lookup.page_context(g, "pm").count() == 0
    assert [(r["server_name"], r["script_name"]) for r in lookup.server_to_script(g).collect()] == [("Catalog", "catalog.js")]
    assert "svc" in reached(traverse.trace_data_flow(g, "pm", 1, "incoming"))


def test_kinds(spark):
    lua = {"type": "Unknown", "foreign_type": "luaModule"}
    g = Graph.build(spark, [{"node_id": "1", "name": "utils"} | lua, {"node_id": "2", "name": "main"} | lua, {"node_id": "3", "type": "Method", "name": "m"}, {"node_id": "4", "type": "Unknown", "name": "u"}], [{"src": "1", "dst": "2", "type": "Unknown", "foreign_type": "requires"}])
    assert lookup.nodes_of_kind(g, "LUAMODULE").count() == 2
    assert lookup.nodes_of_kind(g, "unknown").count() == 1
    assert lookup.nodes_of_kind(g, "luaModule", "util").count() == 1
    assert lookup.foreign_kinds(g) == (["luaModule"], ["requires"])
    assert lookup.resolve_kind(g, "LUAMODULE") == "luaModule" and lookup.resolve_kind(g, "method") == "Method"
    with pytest.raises(lookup.Refusal):
        lookup.resolve_kind(g, "nonsense")
    with pytest.raises(lookup.Refusal):
        lookup.uncovered_methods(g)


def test_upsert_keeps_place(spark):
    g = Graph.build(spark, [{"node_id": "a", "name": "old"}, {"node_id": "b", "name": "b"}, {"node_id": "a", "name": "new"}], [])
    assert [(r["node_id"], r["name"]) for r in g.nodes.orderBy("node_seq").collect()] == [("a", "new"), ("b", "b")]


def method(i, project="Lib", **more):
    return {"node_id": i, "type": "Method", "name": i, "project": project} | more


def test_coverage(spark):
    nodes = [method("T", "Tests", is_test=True, declaring_type="k"), method("hook", "Tests", is_test_lifecycle=True, declaring_type="k"), method("Load"), method("Norm"), method("Iface"), method("Impl"), method("Warm"), method("Orphan"), method("Abstract", is_abstract=True)]
    g = build(spark, [("T", "Calls", "Load"), ("Load", "Calls", "Norm"), ("T", "Calls", "Iface"), ("Impl", "Implements", "Iface"), ("hook", "Calls", "Warm"), ("Norm", "Calls", "Load")], nodes)
    rows = {(r["src"], r["dst"]): r["depth"] for r in coverage(g).collect()}
    assert rows == {("T", "Load"): 1, ("T", "Norm"): 2, ("T", "Iface"): 1, ("T", "Impl"): 2, ("T", "Warm"): 1}
    g = g.with_edges(coverage(g))
    assert {r["node_id"] for r in lookup.uncovered_methods(g, "lib").collect()} == {"Orphan"}
    assert [r["node_id"] for r in lookup.covering_tests(g, "Norm").collect()] == ["T"]
    assert lookup.covered_methods(g, "T").count() == 5


CHAIN = ["Custom", "InvalidOp", "System", "Exception"]


def test_escapes(spark):
    boom = method("U", throws=[("Custom", CHAIN, False)], implements_methods=["IRisky"])
    nodes = [boom, method("IRisky")] + [method(n, "Web", entry_point_kind=k) for n, k in [("OnGet", "pageHandler"), ("OnFlaky", "pageHandler"), ("OnTick", "eventHandler"), ("OnFiltered", "eventHandler"), ("OnPost", "pageHandler")]]
    nodes += [method("Filtering"), method("Guarded"), method("Shaping", boundary_catches=["InvalidOp"]), method("Main", "Cli", entry_point_kind="main", throws=[("Exception", ["Exception"], False)])]
    calls = [("OnGet", "Calls", "U"), ("OnFlaky", "Calls", "IRisky"), ("OnTick", "Calls", "Guarded"), ("Guarded", "Calls", "U"), ("OnFiltered", "Calls", "Filtering"), ("Filtering", "Calls", "U"), ("OnPost", "Calls", "U"), ("OnTick", "Calls", "OnGet")]
    g = build(spark, calls, nodes, Guarded_U={"guarded_by": ["System"]}, Filtering_U={"filtered_by": ["Custom"]}, OnPost_U={"guarded_by": ["*"]})
    g = g.with_edges(escape_edges(g))
    rows = {(r["dst"], r["exception_type"]): r for r in g.edges.where("type = 'Escapes'").collect()}
    assert set(rows) == {("OnGet", "Custom"), ("OnFlaky", "Custom"), ("OnTick", "Custom"), ("OnFiltered", "Custom"), ("Main", "Exception")}
    assert rows["OnGet", "Custom"]["path"] == ["U", "OnGet"] and rows["OnGet", "Custom"]["intercepted_by"] == ["Shaping"]
    assert rows["OnTick", "Custom"]["path"] == ["U", "OnGet", "OnTick"] and rows["OnTick", "Custom"]["intercepted_by"] is None
    assert rows["OnFiltered", "Custom"]["conditional"] and rows["OnFiltered", "Custom"]["depth"] == 2
    assert rows["Main", "Exception"]["depth"] == 0
    report = lookup.escapes_report(g)
    assert [r["entry"] for r in report.collect()][0] == "Main"
    assert lookup.escapes_report(g, exception="cust", project="web", entry_kind="eventHandler").count() == 2
    with pytest.raises(lookup.Refusal):
        lookup.escapes_report(g, "nonsense")


def visibility_graph(spark, nodes=(), edges=()):
    base = [
        {"node_id": "Used", "type": "Class", "name": "Used", "project": "Lib", "is_public": True}, method("Run", is_public=True), method("InternalOnly", is_public=True),
        {"node_id": "Unused", "type": "Class", "name": "Unused", "project": "Lib", "is_public": True}, method("Helper", is_public=True), {"node_id": "Internal", "type": "Class", "name": "Internal", "project": "Lib"},
        {"node_id": "Caller", "type": "Class", "name": "Caller", "project": "App", "is_public": True}, method("Go", "App", is_public=True), {"node_id": "Suite", "type": "Class", "name": "Suite", "project": "Lib.Tests", "is_public": True}, method("T1", "Lib.Tests", is_test=True, is_public=True),
    ]
    links = [("Used", "Contains", "Run"), ("Used", "Contains", "InternalOnly"), ("Unused", "Contains", "Helper"), ("Caller", "Contains", "Go"), ("Suite", "Contains", "T1"), ("Go", "Calls", "Run"), ("Run", "Calls", "Helper"), ("Run", "Calls", "InternalOnly"), ("T1", "Calls", "InternalOnly")]
    return Graph.build(spark, [*base, *nodes], [{"src": a, "dst": b, "type": t, "signature": t == "References"} for a, t, b in [*links, *edges]])


def ids(rows):
    return {r["node_id"] for r in rows.collect()}


def test_visibility(spark):
    g = visibility_graph(spark)
    assert ids(excess_visibility(g, "lib")) == {"Unused", "InternalOnly"}
    assert ids(excess_visibility(g, "Lib", include_tests=True)) == {"Unused"}
    assert {r["node_id"]: r["consumed_by"] for r in consumers(g).collect()}["InternalOnly"] == ["Lib", "Lib.Tests"]


def cls(i, **more):
    return {"node_id": i, "type": "Class", "name": i, "project": "Lib", "is_public": True} | more


def test_visibility_of_what_is_exposed(spark):
    g = visibility_graph(spark, [cls("Dto"), cls("Inner"), method("Unwrap", is_public=True), method("Open", is_public=True), cls("IPort", is_interface=True)], [("Run", "References", "Dto"), ("Dto", "Contains", "Unwrap"), ("Unwrap", "References", "Inner"), ("IPort", "Contains", "Open"), ("Go", "Calls", "IPort")])
    assert ids(excess_visibility(g, "Lib")) == {"Unused", "InternalOnly", "Unwrap", "Inner"}
    g = visibility_graph(spark, [method("Over", is_public=True, is_override=True), method("Ctor", is_public=True), {"node_id": "Name", "type": "Property", "name": "Name", "project": "Lib", "is_public": True}], [("Used", "Contains", "Over"), ("Internal", "Contains", "Ctor"), ("Used", "Contains", "Name")])
    assert ids(excess_visibility(g, "Lib")) == {"Unused", "InternalOnly"}
    assert ids(excess_visibility(g, "Lib", include_members=True)) == {"Unused", "InternalOnly", "Name"}


def test_visibility_of_deep_and_circular_owners(spark):
    """A member 70 types deep pins what it exposes; owners in a circle end the walk and pin nothing."""
    deep = [cls(f"D{i:02}", project="Lib") for i in range(70)]
    chain = [(f"D{i:02}", "Contains", f"D{i + 1:02}") for i in range(69)] + [("D69", "Contains", "Leaf"), ("Leaf", "References", "Shown"), ("Go", "Calls", "D69"), ("A", "Contains", "B"), ("B", "Contains", "A"), ("A", "References", "Hidden"), ("Go", "Calls", "Leaf")]
    g = visibility_graph(spark, [*deep, method("Leaf", is_public=True), cls("Shown"), cls("A"), cls("B"), cls("Hidden")], chain)
    assert {"Shown", "Leaf", "D00", "D69"} & ids(excess_visibility(g, "Lib")) == set()
    assert {"A", "B", "Hidden"} <= ids(excess_visibility(g, "Lib"))


def test_quotes(spark):
    from codeweft.operators.folds import quote_edges

    nodes = [{"node_id": "s", "type": "Class", "name": "CatalogStore", "project": "Lib"}, {"node_id": "d1", "type": "Method", "name": "Dispose", "project": "Lib"}, {"node_id": "d2", "type": "Method", "name": "Dispose", "project": "Web"}, method("typed", "Web"), method("safe", "Web"), method("own")]
    g = Graph.build(spark, nodes, [])
    quotes = spark.createDataFrame([("typed", "CatalogStore", "literal", 3), ("typed", "CatalogStore", "literal", 2), ("safe", "CatalogStore", "nameof", 1), ("typed", "Dispose", "literal", 1), ("own", "CatalogStore", None, 1), ("s", "CatalogStore", "literal", 1)], "src string, value string, provenance string, line int")
    g = g.with_edges(quote_edges(g, quotes))
    assert [(r["src"], r["line"]) for r in lookup.quoted_symbols(g).collect()] == [("typed", 2)]
    assert {r["src"] for r in lookup.quoted_symbols(g, safe=True).collect()} == {"typed", "safe"}
    assert {r["src"] for r in lookup.quoted_symbols(g, same_project=True).collect()} == {"typed", "own"}


def test_page_envelope(spark):
    rows, envelope = lookup.page(spark.range(5).toDF("n"), 2)
    assert rows.count() == 2 and envelope == {"returned": 2, "totalMatches": 5, "truncated": True}
    assert lookup.page(spark.range(5).toDF("n"), 0)[1]["returned"] == 1
