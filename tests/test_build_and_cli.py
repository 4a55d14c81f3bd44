"""Composed graphs and the command line."""

import json

import pytest

from codeweft.build import build_lua, build_solution
from codeweft.cli import main
from codeweft.model import Graph
from codeweft.sources.codec import save_graph, write_tables


@pytest.fixture(scope="module")
def solution(spark):
    df = spark.createDataFrame
    symbols = df([("type:H", 0, "PageModel", "HomeModel", "App.HomeModel", "App", True), ("svc:S", 1, "ServiceImplementation", "Store", "App.Store", "Lib", True)], "id string, seq long, type string, name string, full_name string, project string, is_public boolean")
    ddl = "id string, seq long, type string, name string, owner string, project string, attributes array<string>, is_ctor boolean, is_fixture_hook boolean, entry_point_kind string"
    methods = df([("m:get", 10, "Method", "OnGet", "type:H", "App", [], False, False, "pageHandler"), ("m:load", 11, "Method", "Load", "svc:S", "Lib", [], False, False, None), ("m:test", 12, "Method", "T", "type:T", "Tests", ["FactAttribute"], False, False, None)], ddl)
    sites = df([("m:get", "m:load", None, None, False), ("m:test", "m:load", None, None, False), ("m:get", "gone", None, None, False)], "src string, dst string, guarded_by array<string>, filtered_by array<string>, via_delegate boolean")
    throws = df([("m:load", "X", ["X", "Exception"], False)], "method string, type string, chain array<string>, conditional boolean")
    pages = df([("page:Home", "Pages/Home.cshtml", '@page\n@model App.HomeModel\n<input asp-for="Name"><div data-k="@Model.K"></div><script src="~/js/a.js"></script>')], "id string, path string, text string")
    assets = df([("js:a", "js/a.js", "el.dataset.k;")], "id string, path string, text string")
    return build_solution(spark, {"symbols": symbols, "methods": methods, "call_sites": sites, "throws": throws, "pages": pages, "assets": assets, "injections": df([("type:H", "App.IStore")], "id string, service string")})


def test_build_solution(solution):
    edges = {(r["src"], r["type"], r["dst"]) for r in solution.edges.collect()}
    assert edges >= {
        ("type:H", "Contains", "m:get"), ("m:get", "Calls", "m:load"), ("m:test", "Calls", "m:load"), ("page:Home", "PageServedBy", "type:H"), ("type:H", "ReturnsView", "page:Home"), ("page:Home", "RendersComponent", "th:page:Home:3"),
        ("th:page:Home:3", "BindsTo", "type:H"), ("page:Home", "ViewDataReadBy", "js:a"), ("svc:S", "InjectedInto", "type:H"), ("m:load", "Escapes", "m:get"), ("m:test", "Covers", "m:load"),
    }
    assert ("m:get", "Calls", "gone") not in edges
    assert {r["node_id"] for r in solution.nodes.where("is_test").collect()} == {"m:test"}


def test_unknown_facts(spark):
    with pytest.raises(ValueError, match="unknown fact tables"):
        build_solution(spark, {"nonsense": spark.range(1)})


def test_build_lua(spark):
    df = spark.createDataFrame
    facts = {
        "modules": df([("main", "main.lua", "plugin"), ("util", "util.lua", "plugin")], "module string, path string, host string"), "functions": df([("util", "help", 4)], "module string, name string, line int"),
        "references": df([("main", "util", 1, "require")], "module string, name string, line int, kind string"), "external": df([("Sdk",)], "module string"),
        "calls": df([("main", "f", "u.help", "u", "help", 5), ("main", "f", "s.run", "s", "run", 6)], "module string, function string, callee string, receiver string, method string, line int"),
        "bindings": df([("main", "u", "util", False), ("main", "s", "Sdk", True)], "module string, local string, target string, external boolean"),
        "catalogue": df([], "module string, function string, since string, retired string, documented boolean"), "instance_methods": df([], "method string"),
    }
    graph, counters = build_lua(spark, facts)
    assert {(r["src"], r["type"], r["dst"]) for r in graph.edges.collect()} == {("mod:util", "Contains", "mod:util.help#4"), ("mod:main", "DependsOn", "mod:util"), ("mod:main", "Calls", "mod:util.help#4"), ("mod:main", "Calls", "ext:Sdk.run")}
    assert {r["node_id"] for r in graph.nodes.collect()} == {"mod:main", "mod:util", "mod:util.help#4", "ext:Sdk.run"} and counters.first()["inGraph"] == 1


def test_query_modes(spark, solution, tmp_path, capsys):
    folder = str(tmp_path / "g")
    write_tables(solution, folder)

    def run(*args, code=0):
        assert main(["query", folder, "--json", *args], spark) == code
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert run()["mode"] == "summary"
    assert run("--escapes", "--uncovered", "--id", "m:get")["mode"] == "escapes" and run("--mismatches", "--escapes")["rows"][0]["script"] == "js:a"
    assert {r["node_id"] for r in run("--uncovered", "--deep", "1")["rows"]} == {"m:get"}
    assert [r["node_id"] for r in run("--id", "m:load", "--covering-tests")["rows"]] == ["m:test"]
    assert {r["node_id"] for r in run("--id", "m:get", "--trace")["rows"]} >= {"m:load"}
    assert run("--type", "PAGEMODEL", "--name", "zzz")["rows"] == [] and len(run("--name", "home")["rows"]) == 2
    assert run("--type", "Nonsense", code=1)["mode"] == "error" and run("--id", "nobody", code=1)["error"]
    assert main(["query", str(tmp_path / "none")], spark) == 2 and main(["nonsense"], spark) == 2
    save_graph(solution, str(tmp_path / "g.json"))
    assert main(["research", str(tmp_path / "g.json"), "--focus", "m:get", "-o", str(tmp_path / "r" / "out")], spark) == 0


def test_body_diff_exit_codes(spark, tmp_path, capsys):
    ddl = "body string, ordinal int, kind string, operations array<string>, calls array<string>, condition string, when_true int, when_false int, falls_to int, region int"
    rows = lambda b, op: [(b, 0, "Entry", [], [], None, None, None, 1, 0), (b, 1, "Block", [op], [], None, None, None, 2, 0), (b, 2, "Exit", [], [], None, None, None, None, 0)]
    spark.createDataFrame([*rows("a", "x"), *rows("b", "x"), *rows("c", "y")], ddl).write.parquet(str(tmp_path / "blocks"))
    spark.createDataFrame([(b, 0, None, "Root", None) for b in "abc"], "body string, id int, parent int, kind string, exception_type string").write.parquet(str(tmp_path / "regions"))
    spark.createDataFrame([(b, 1) for b in "abc"], "body string, depth int").write.parquet(str(tmp_path / "depths"))
    diff = lambda *more: main(["body-diff", str(tmp_path), "--method", "a", *more], spark)
    assert (diff("--against", "b"), diff("--against", "c"), diff("--against", "z"), diff(), diff("--baseline", str(tmp_path))) == (0, 1, 2, 2, 0)
    assert main(["body", str(tmp_path), "--method", "a"], spark) == 0 and main(["body", str(tmp_path), "--method", "z"], spark) == 2


def test_limits_of_reports(spark):
    from codeweft.api import report

    rows = spark.range(1000).toDF("n")
    assert len(json.loads(report(rows))["rows"]) == 1000
    text = report(rows, as_json=False, text_limit=200).splitlines()
    assert len(text) == 201 and text[-1] == "... and 800 more" and len(report(rows, as_json=False).splitlines()) == 1000
    assert Graph.build(spark, [], []).nodes.count() == 0
