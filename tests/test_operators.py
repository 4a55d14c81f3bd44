"""Scanners, resolvers, declarations, bodies, Lua, codec and registry on small inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from codeweft.functions import paths, scan
from codeweft.model import Graph
from codeweft.operators import binding, bodies, client, declarations, folds, lua
from codeweft.sources import codec, files
from codeweft.sources.registry import Registry


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


SCRIPT = """
/* el.dataset.gone */
// getElementById('gone')
const a = el.dataset.greetingText; el.dataset.clientOwned = 1; if (el.dataset.state == 2) {}
b.setAttribute("data-written", 1); c.getAttribute('data-read-it'); q('[data-sel="1"]');
document.getElementById('card-title'); document.getElementById('row-' + i); document.querySelector("#total .x #y"); $('#jq');
n.id = 'popup'; document.querySelector('#popup'); fetch(`/api/Greetings/${id}`); $.get('/api/other'); fetch('https://x.y/z');
"""


def test_script_scanners(spark):
    get = lambda f: one(spark, f(F.col("t")), t=SCRIPT)
    assert set(get(scan.data_keys)) == {"greeting-text", "client-owned", "state", "written", "read-it", "sel"}
    assert set(get(scan.data_keys_written)) == {"client-owned", "written"}
    assert set(get(scan.read_only_keys)) == {"greeting-text", "state", "read-it", "sel"}
    assert set(get(scan.foreign_ids)) == {"card-title", "total", "y", "jq"}
    assert get(scan.dynamic_selectors) == 1
    assert get(scan.api_calls) == ["/api/Greetings/", "/api/other"]
    assert one(spark, scan.api_segment(F.col("t")), t="/api/Greetings/1?x") == "Greetings"


PAGE = """@page "/cat/{id}"
@model Shop.CatalogModel
@* <partial name="_Gone" />
*@
@inject IStore Store
@section Scripts { }
@{ Layout = "_Main"; var x = ViewData["Title"]; }
<link rel=stylesheet href="~/css/site.css?v=1"><script src='~/js/site.js'></script>
<div id="plain" data-greeting="@Model.G" data-fixed='1'><span id="row-@i"></span></div>
<input asp-for="Contact.Lines[0]" class="c"><partial name="_Card" />
@await Html.PartialAsync("_Other")
<script>let a = 1;
</script><script> </script>
"""


def test_page_scanners(spark):
    get = lambda f: one(spark, f(F.col("t")), t=PAGE)
    assert get(scan.is_page) and get(scan.route_template) == "/cat/{id}" and get(scan.model_directive) == "Shop.CatalogModel"
    assert get(scan.inject_directives) == ["IStore Store"] and get(scan.sections) == ["Scripts"] and get(scan.layout) == "_Main" and get(scan.view_data_keys) == ["Title"]
    assert get(scan.asset_references) == ["~/js/site.js", "~/css/site.css?v=1"]
    assert len(get(scan.inline_scripts)) == 1
    assert get(scan.bound_data_keys) == ["greeting"] and get(scan.rendered_data_keys) == ["greeting", "fixed"]
    assert get(scan.rendered_ids) == ["plain", "Contact_Lines_0"] and get(scan.dynamic_ids) == 1
    found = one(spark, scan.partial_renders(scan.strip_page_comments("t")), t=PAGE)
    assert [(p["name"], p["is_tag"], p["line"]) for p in found] == [("_Card", True, 10), ("_Other", False, 11)]
    assert [h["tag"] for h in one(spark, scan.tag_helpers("t"), t=PAGE)] == ["input"]


@pytest.mark.parametrize("href,path", [("~/js/a.js?v=2", "js/a.js"), ("/css/b.css#x", "css/b.css"), ("https://cdn/x.js", None), ("//cdn/x.js", None), ("", None), ("~/", None)])
def test_asset_path(spark, href, path):
    assert one(spark, scan.asset_path(F.col("h")), h=href) == path


def test_paths(spark):
    vendor = lambda p, **k: one(spark, paths.vendor_reason(F.col("p"), **k), p=p)
    assert vendor("lib_npm/x/a.js") == "vendor directory 'lib_npm'" and vendor("js/@scope/a.js") == "npm scope '@scope'" and vendor("js/a.min.js") == "minified"
    assert vendor("mylib/a.js") is None and vendor("drop/x/a.js", drop_roots=["Drop"]) == "package drop 'drop'" and vendor("kit/x/a.js", manifest_dirs=["kit"]) == "package manifest in 'kit'"
    shapes = lambda n: one(spark, paths.shape_candidates(F.col("n")), n=n)
    assert shapes("Menu__Main") == ["Menu-Main", "Menu", "Menu__Main"]
    assert shapes("Content_Summary__Article__Big") == ["Content-Article-Big.Summary", "Content-Article.Summary", "Content.Summary", "Content-Article-Big", "Content-Article", "Content", "Content_Summary__Article__Big"]
    assert shapes("Menu") == ["Menu"] and shapes(" ") == [] and shapes("__") == []
    assert one(spark, paths.lua_module(F.col("p")), p="a/b/init.lua") == "a.b"
    assert one(spark, paths.version_array(F.col("p")), p="1.10") == [1, 10] and one(spark, paths.version_array(F.col("p")), p="x") is None
    roots = paths.drop_roots(spark.createDataFrame([("a", "vue"), ("a", "moment"), ("b", "vue")], "root string, child string"), spark.createDataFrame([("vue",), ("Moment",)], "name string"))
    assert [r["root"] for r in roots.collect()] == ["a"]


def test_view_resolution(spark):
    templates = spark.createDataFrame([(p,) for p in ("Views/Menu/Edit.cshtml", "Views/Node/Edit.cshtml", "Views/Shared/_Card.cshtml", "Pages/Cat/_Card.cshtml", "Mod/Odd/Lone.cshtml")], "path string")
    wanted = [("a", "Edit", None, "Node"), ("b", "_Card", "Pages/Cat/Index.cshtml", None), ("c", "~/Views/Shared/_Card.cshtml", None, None), ("d", "lone", "Pages/X.cshtml", None), ("e", "None", None, None)]
    rows = paths.resolve_views(spark.createDataFrame(wanted, "k string, name string, source string, controller string"), templates, ["k"])
    assert {r["k"]: r["path"] for r in rows.where("rank = 0").collect()} == {"a": "Views/Node/Edit.cshtml", "b": "Pages/Cat/_Card.cshtml", "c": "Views/Shared/_Card.cshtml", "d": "Mod/Odd/Lone.cshtml"}


def test_client_contract(spark):
    pages = spark.createDataFrame([("page:Index", "Index.cshtml", '@page\n<div data-greeting="@Model.G" data-state="x"></div><partial name="_Card"/><script src="~/js/site.js"></script>'), ("page:_Card", "_Card.cshtml", '<b id="card-title"></b>')], "id string, path string, text string")
    script = "el.dataset.greeting; el.dataset.state; el.dataset.missingKey; document.getElementById('card-title'); document.getElementById('cart-count'); fetch('/api/greetings/1')"
    scripts = client.script_facts(spark.createDataFrame([("js:site", "js/site.js", script)], "id string, path string, text string")).cache()
    facts = client.page_facts(pages).cache()
    edges, stubs = client.partial_edges(facts, pages.select("id", "path"))
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("page:Index", "page:_Card")] and stubs.count() == 0
    loads = client.loaded_scripts(facts, scripts.select("id", "path"))
    scopes = client.composed_scopes(facts, edges).cache()
    found = {(r["src"], r["type"]): json.loads(r["props"]) for r in client.coupling_edges(scopes, loads, scripts).collect()}
    assert found == {("page:Index", "ViewDataReadBy"): {"dataKeys": ["greeting"]}, ("page:Index", "DomSelectedBy"): {"ids": ["card-title"]}}
    row = client.unbound_names(scopes, loads, scripts).first()
    assert row["keys"] == ["missing-key"] and row["ids"] == ["cart-count"]
    nodes = Graph.build(spark, [{"node_id": "ctrl", "type": "ApiController", "name": "GreetingsController"}], []).nodes
    assert [(r["src"], r["dst"]) for r in client.api_edges(scripts, nodes).collect()] == [("js:site", "ctrl")]
    assert {r["type"] for r in client.page_nodes(facts).collect()} == {"RazorPage", "PartialView"}


def test_binding(spark):
    mentions = spark.createDataFrame([("Menu__Main", "m1", False, False, 1), ("Lost", "m2", False, False, 2), ("Lost", "m3", True, False, 2), ("Maybe", "m4", True, False, 3), ("Hidden", "m5", False, False, 4)], "name string, by string, is_alternate boolean, in_test boolean, line int")
    text = '{ // Lost: banner\n "Hidden": [ {"place": "-"} ],\n "Lost": [ {"place": "-", "contentType": "X", "alternates": "Lost__A", "wrappers": ["Wrap"], "shape": "New"}, ] }'
    rules = files.placements(spark.createDataFrame([("p.json", text)], "path string, text string")).cache()
    assert {(r["shape"], r["line"], r["hides"], r["unconditional"]) for r in rules.collect()} == {("Hidden", 2, True, True), ("Lost", 3, True, False)}
    assert {(r["name"], r["is_alternate"]) for r in binding.placement_mentions(rules).collect()} == {("Lost__A", True), ("Wrap", False), ("New", False)}
    shapes = binding.shape_nodes(mentions).cache()
    templates = spark.createDataFrame([("t1", "V/Menu.cshtml", "A"), ("t2", "V/Menu-Main.cshtml", "A"), ("t3", "W/menu.cshtml", "B")], "id string, path string, project string")
    named = shapes.withColumn("projects", F.array(F.lit("A")))
    seen = binding.visible_projects(spark.createDataFrame([("A",), ("B",)], "name string"), spark.createDataFrame([], "src string, dst string"))
    bound = binding.shape_bindings(named, templates, seen)
    assert [(r["template"], r["rank"]) for r in bound.orderBy("rank").collect()] == [("t2", 0), ("t1", 1)]
    verdicts = {r["name"]: r["verdict"] for r in binding.shape_verdicts(shapes, bound, rules).collect()}
    assert verdicts == {"Menu__Main": "bound", "Lost": "unbound", "Maybe": "noRequiredProducer", "Hidden": "renderSuppressed"}
    calls = spark.createDataFrame([("m", 1, "Menu", "X", 5), ("m", 2, None, "X", 6), ("m", 3, "Nope", "X", 7)], "method string, call int, name string, controller string, line int")
    edges, found = binding.view_edges(calls, templates.where("project = 'A'"))
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("m", "t1")]
    assert [(r["missing"], r["unresolved"]) for r in found.collect()] == [(["Nope"], 1)]


def test_declarations(spark):
    nodes = Graph.build(spark, [{"node_id": "type:A", "type": "Class", "name": "A", "full_name": "N.A", "project": "P"}, {"node_id": "svc:S", "type": "ServiceImplementation", "name": "Store", "full_name": "N.Store", "project": "P"}, {"node_id": "m:1", "type": "Method", "name": "x"}], []).nodes
    rows = lambda df: {(r["src"], r["dst"]) for r in df.collect()}
    assert rows(declarations.inheritance_edges(spark.createDataFrame([("type:B", "N.A"), ("type:C", "Out.X")], "id string, base_type string"), nodes)) == {("type:B", "type:A")}
    facts = spark.createDataFrame([("m:1", "type:A", ["N.A", "N.Store"], True), ("m:2", "type:B", ["N.A"], False)], "id string, owner string, names array<string>, signature boolean")
    assert rows(declarations.reference_edges(facts, nodes)) == {("m:1", "svc:S"), ("m:2", "type:A")}
    assert rows(declarations.injection_edges(spark.createDataFrame([("type:A", "N.IStore"), ("m:1", "N.A"), ("m:1", "Out.INone")], "id string, service string"), nodes)) == {("svc:S", "type:A"), ("type:A", "m:1")}
    usage = ("m:1", "X.FactAttribute", "Fact", "xunit", None, 3, "s", "[1]")
    usages = spark.createDataFrame([usage, usage, ("m:1", "N.A", "A", "own", None, 4, "s", None)], "id string, attribute string, name string, assembly string, target string, line int, source string, args string")
    edges, outside = declarations.attribute_edges(usages, nodes)
    assert rows(edges) == {("m:1", "ext:X.FactAttribute"), ("m:1", "type:A")} and edges.count() == 2 and [r["node_id"] for r in outside.collect()] == ["ext:X.FactAttribute"]
    roles = declarations.with_roles(spark.createDataFrame([("t", "k", ["Fact"], False), ("c", "k", [], True), ("o", "z", [], True)], "id string, declaring_type string, attributes array<string>, is_ctor boolean").withColumn("is_fixture_hook", F.lit(False)))
    assert {(r["id"], r["is_test"], r["is_test_lifecycle"]) for r in roles.collect()} == {("t", True, False), ("c", False, True), ("o", False, False)}
    assert declarations.merged_policy({"registering": ["R"], "test_attributes": None})["test_attributes"] == declarations.DEFAULT_POLICY["test_attributes"]
    stamped = folds.callback_stamps(nodes, spark.createDataFrame([("m:1",)], "node_id string"))
    assert stamped.where("entry_point_kind = 'callback'").count() == 1


def test_folds(spark):
    nodes = Graph.build(spark, [{"node_id": x} for x in "abc"], []).nodes
    sites = [("a", "b", ["*"], None, True), ("a", "b", ["X", "Y"], None, True), ("a", "b", ["Y", "Z"], None, False), ("a", "c", ["*"], ["F"], True), ("a", "gone", None, None, True), ("b", "c", ["X"], None, None), ("b", "c", None, None, None)]
    rows = folds.call_edges(spark.createDataFrame(sites, "src string, dst string, guarded_by array<string>, filtered_by array<string>, via_delegate boolean"), nodes)
    assert {(r["src"], r["dst"]): (r["guarded_by"], r["filtered_by"], r["via_delegate"]) for r in rows.collect()} == {("a", "b"): (["Y"], None, False), ("a", "c"): (["*"], ["F"], True), ("b", "c"): (None, None, False)}
    thrown = folds.thrown_types(spark.createDataFrame([("m", "T", True), ("m", "T", None), ("m", "U", True)], "method string, type string, conditional boolean"))
    assert {(r["type"], r["conditional"]) for r in thrown.collect()} == {("T", False), ("U", True)}


def block(body, ordinal, kind="Block", ops=(), calls=(), cond=None, t=None, f=None, to=None, region=0):
    return (body, ordinal, kind, list(ops), list(calls), cond, t, f, to, region)


def test_bodies(spark):
    same = [block("a", 0, "Entry", to=1), block("a", 1, ops=["x"], calls=["m"], cond="p", t=2, f=3), block("a", 2, "Exit"), block("a", 3, "Exit")]
    moved = [block("b", 0, "Entry", to=5), block("b", 5, ops=["x"], calls=["m"], cond="p", t=7, f=9), block("b", 7, "Exit"), block("b", 9, "Exit")]
    other = [block("c", 0, "Entry", to=1), block("c", 1, ops=["y"], calls=["m", "n"]), block("c", 2, "Exit")]
    blocks = spark.createDataFrame([*same, *moved, *other], "body string, ordinal int, kind string, operations array<string>, calls array<string>, condition string, when_true int, when_false int, falls_to int, region int")
    regions = spark.createDataFrame([(b, 0, None, "Root", None) for b in "abc"], "body string, id int, parent int, kind string, exception_type string")
    depths = spark.createDataFrame([("a", 4), ("b", 1)], "body string, depth int")
    rows = {r["pair"]: r for r in bodies.body_diff(spark.createDataFrame([(1, "a", "b"), (2, "a", "c")], "pair int, left string, right string"), blocks, regions, depths).collect()}
    assert rows[1]["equivalent"] and rows[1]["depth_left"] == 4 and rows[1]["depth_right"] == 1
    assert not rows[2]["equivalent"] and rows[2]["calls_only_right"] == ["n"] and len(rows[2]["differences"]) == 1
    assert bodies.canonical_condition("!(a == b)") == ("a == b", True) and bodies.canonical_condition("a != b") == ("a == b", True) and bodies.canonical_condition("a >= b", floating=True) == ("a >= b", False)


def test_lua(spark):
    df = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    modules = df([("main", "main.lua", "plugin"), ("util", "util.lua", "plugin"), ("dead", "dead.lua", "plugin")], "module string, path string, host string")
    refs = lua.resolved_references(df([("main", "util", 1, "require"), ("main", "Sdk", 2, "import"), ("main", "nope", 3, "require")], "module string, name string, line int, kind string"), modules, df([("Sdk",)], "module string")).cache()
    assert {(r["name"], r["outcome"]) for r in refs.collect()} == {("util", "inGraph"), ("Sdk", "external"), ("nope", "unresolved")}
    functions = df([("util", "help", 4), ("main", "own", 9)], "module string, name string, line int")
    calls = df([("main", "f", "u.help", "u", "help", 5), ("main", "f", "own", None, None, 6), ("main", "f", "print", None, None, 7), ("main", "f", "s.run", "s", "run", 8), ("main", "f", "o:close", "o", "close", 9), ("main", "f", "x.y", "x", "y", 10)], "module string, function string, callee string, receiver string, method string, line int")
    bindings = df([("main", "u", "util", False), ("main", "s", "Sdk", True)], "module string, local string, target string, external boolean")
    catalogue = df([("Sdk", "run", "2.10", None, True), ("Sdk", "old", "1.0", "3.0", True)], "module string, function string, since string, retired string, documented boolean")
    found = lua.resolved_calls(calls, bindings, functions, catalogue, df([("close",)], "method string")).cache()
    assert {r["callee"]: r["outcome"] for r in found.collect()} == {"u.help": "module", "own": "sameModule", "print": "standard", "s.run": "external", "o:close": "instance", "x.y": "unresolved"}
    floor = lua.version_floor(df([("p", "Sdk.run"), ("p", "Sdk.old")], "plugin string, function string"), catalogue)
    assert [tuple(r) for r in floor.collect()] == [("p", "2.10", ["Sdk.run"])]
    roots = df([("main",)], "module string")
    assert [r["path"] for r in lua.unreachable(modules, roots, refs).collect()] == ["dead.lua"] and lua.unreachable(modules, roots.limit(0), refs).count() == 0
    manifest = df([("p", "Info.lua", "LrSdkVersion", "2.9", 1), ("p", "Info.lua", "Odd", "x", 2)], "plugin string, path string, key string, value string, line int")
    rules, failed = lua.run_rules([lambda: lua.dialect(df([("b.lua", 7, "goto"), ("b.lua", 3, "goto")], "path string, line int, message string")), lambda: lua.manifest_rule(manifest, ["Name"], ["Name", "LrSdkVersion"], floor, "LrSdkVersion"), lambda: modules.select("none")])
    rows = [(r["severity"], r["path"], r["line"]) for r in rules.collect()]
    assert rows == [("Error", "Info.lua", 1), ("Error", "b.lua", 3), ("Warning", "Info.lua", 1), ("Note", "Info.lua", 2)] and len(failed) == 1


def test_codec(spark, tmp_path):
    nodes = [{"node_id": "p", "type": "RazorPage", "name": "P", "line_start": 1, "line_end": 20, "is_public": True, "labels": ["x"], "props": '{"deep":{"a":[1,null,"s"]},"n":2.5}'}, {"node_id": "l", "type": "Unknown", "foreign_type": "luaModule", "name": "l"}]
    g = Graph.build(spark, nodes, [{"src": "p", "dst": "l", "type": "RendersPartial", "line": 8, "props": '{"isTagHelper":true}'}], built_at=dt.datetime(2024, 5, 1, tzinfo=dt.UTC))
    codec.save_graph(g, str(tmp_path / "g"))
    back, found = codec.load_graph(spark, str(tmp_path / "g"))
    assert found.caveat is None and back.built_at == g.built_at
    rows = {r["node_id"]: r for r in back.nodes.collect()}
    assert rows["p"]["is_public"] and rows["p"]["line_end"] == 20 and rows["p"]["labels"] == ["x"] and json.loads(rows["p"]["props"])["deep"] == {"a": [1, None, "s"]}
    assert rows["l"]["foreign_type"] == "luaModule" and rows["l"]["type"] == "Unknown"
    edge = back.edges.first()
    assert edge["line"] == 8 and json.loads(edge["props"])["isTagHelper"] is True
    assert [tuple(r) for r in codec.foreign_data(back).collect()] == [("node", "luaModule", 1)]
    codec.write_tables(g, str(tmp_path / "t"))
    assert codec.read_tables(spark, str(tmp_path / "t")).nodes.count() == 2


def test_versions():
    assert codec.assess(None).supported and codec.assess(None).caveat
    assert codec.assess("1.2").caveat is None and codec.assess("1.9").caveat and codec.assess("0.3").caveat
    assert not codec.assess("2.0").supported
    for bad in ("1", "1.x", "1.2.3", "-1.0", ""):
        with pytest.raises(codec.FormatError):
            codec.assess(bad)


def test_registry(spark):
    r, g = Registry(), Graph.build(spark, [], [])
    assert r.add(g, "/x/Shop.graph.json") == "Shop" and r.add(g, "/y/shop.graph.json") == "shop-2" and r.add(g, "/x/Shop.graph.json") == "Shop"
    assert r.require() is g and r.require("SHOP-2") is g
    assert r.remove("shop") and not r.remove("shop")
    with pytest.raises(LookupError):
        r.require()
    assert [e.graph_id for e in r.list()] == ["shop-2"]


def test_freshness(spark):
    g = Graph.build(spark, [{"node_id": "a", "file_path": "a.cs"}, {"node_id": "b", "file_path": "b.cs"}, {"node_id": "c", "file_path": "c.cs"}, {"node_id": "d"}], [], built_at=dt.datetime(2024, 1, 2, tzinfo=dt.UTC))
    seen = spark.createDataFrame([("a.cs", dt.datetime(2024, 1, 1)), ("b.cs", dt.datetime(2024, 1, 3))], "path string, modified timestamp")
    assert {r["node_id"]: r["written_since"] for r in files.freshness(g, seen).collect()} == {"a": False, "b": True, "c": True, "d": None}


def test_stream_of_facts(spark, tmp_path):
    from codeweft.streaming.facts import NodeTable

    table = NodeTable(spark, f"file://{tmp_path}/nodes")
    batch = lambda *r: spark.createDataFrame(r, "node_id string, name string, node_seq long")
    table.merge(batch(("a", "1", 0), ("b", "1", 1)), 0)
    table.merge(batch(("a", "2", 0)), 1)
    table.merge(batch(("a", "2", 0)), 1)
    assert {(r["node_id"], r["name"]) for r in table.read().collect()} == {("a", "2"), ("b", "1")}
