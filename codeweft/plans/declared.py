"""Registered queries over declared symbols, Lua modules and method bodies, with SQL on the same facts."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..model import Graph
from ..operators import bodies, declarations, folds, lookup, lua, traverse
from ..sources import codec, files
from ..store import fresh_path
from .sources import facts
from .suite import query

_joined = partial(F.array_join, delimiter=",")


def _some(*columns: str) -> Column:
    """An array of the columns that aren't null."""
    return F.array_compact(F.array(*columns))


# Classifiers

_TYPES = """
SELECT p_partkey AS id, concat('T', p_partkey, CASE p_size % 6 WHEN 0 THEN 'Service' WHEN 1 THEN 'VM' WHEN 2 THEN 'ViewModel' WHEN 3 THEN 'Model' WHEN 4 THEN 'Repository' ELSE 'Dto' END) AS name,
  CASE p_partkey % 7 WHEN 0 THEN 'Microsoft.AspNetCore.Mvc.RazorPages.PageModel' WHEN 1 THEN 'My.ControllerBase' END AS base, CASE WHEN p_partkey % 11 = 0 THEN 'ApiControllerAttribute' END AS attribute,
  CASE WHEN p_partkey % 5 = 0 THEN 'Shop.IFooService' END AS interface, p_partkey % 3 = 0 AS is_interface FROM part
"""


@query(
    "type_kinds",
    f"""SELECT id, CASE WHEN base LIKE '%PageModel%' THEN 'PageModel' WHEN base LIKE '%Controller%' OR attribute IS NOT NULL THEN 'ApiController' WHEN ends_with(name, 'Service') OR interface IS NOT NULL THEN CASE WHEN is_interface THEN 'ServiceInterface' ELSE 'ServiceImplementation' END
  WHEN ends_with(name, 'VM') OR ends_with(name, 'Model') THEN 'ViewModel' ELSE 'Class' END AS kind FROM ({_TYPES})""",
)
def _(spark, sf_dir):
    return facts(spark, sf_dir, _TYPES).select("id", declarations.type_kind(F.col("name"), F.col("base"), F.col("is_interface"), _some("attribute"), _some("interface")).alias("kind"))


_METHODS = """
SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN 'Main' WHEN 1 THEN 'OnGetX' WHEN 2 THEN 'Invoke' WHEN 3 THEN 'Index' WHEN 4 THEN 'OnTick' WHEN 5 THEN 'OnStartup' WHEN 6 THEN 'Run' ELSE 'OnPostAsync' END AS name, o_custkey % 5 = 0 AS is_static, o_orderstatus <> 'P' AS is_public,
  CASE o_custkey % 3 WHEN 0 THEN 'PageModel' WHEN 1 THEN 'ApiController' ELSE 'Class' END AS owner_kind, o_orderkey % 7 = 0 AS is_event_handler, o_orderkey % 4 = 1 AS is_async, CASE WHEN o_orderkey % 3 = 0 THEN 'void' ELSE 'Task' END AS return_type,
  o_orderkey % 6 = 0 AS is_override, o_orderkey % 12 = 0 AS overrides_outside, CASE WHEN o_custkey % 2 = 0 THEN 'Microsoft.AspNetCore.Http.HttpContext' ELSE 'int' END AS parameter, CASE WHEN o_custkey % 4 < 2 THEN 'Shop.AuthMiddleware' ELSE 'Shop.Thing' END AS declaring_type,
  o_orderkey % 9 = 0 AS implements_outside, CASE WHEN o_custkey % 8 = 2 THEN true END AS is_middleware_type, CASE WHEN o_orderpriority = '1-URGENT' THEN 'FactAttribute' WHEN o_orderpriority = '2-HIGH' THEN 'ClassInitializeAttribute' END AS attribute FROM orders
"""


@query(
    "entry_kinds",
    f"""SELECT id, CASE WHEN attribute = 'FactAttribute' THEN NULL WHEN name = 'Main' AND is_static THEN 'main' WHEN owner_kind = 'PageModel' AND name IN ('OnGetX', 'OnPostAsync') AND is_public AND NOT is_static THEN 'pageHandler' WHEN owner_kind = 'ApiController' AND is_public AND NOT is_static THEN 'controllerAction'
  WHEN is_event_handler THEN 'eventHandler' WHEN is_async AND return_type = 'void' THEN 'asyncVoid' WHEN is_override AND overrides_outside THEN 'frameworkOverride'
  WHEN name = 'Invoke' AND NOT is_static AND parameter LIKE '%HttpContext' AND (declaring_type LIKE '%Middleware' OR is_middleware_type) THEN 'middleware' WHEN implements_outside AND NOT is_static THEN 'frameworkInterface' END AS entry_kind FROM ({_METHODS})""",
)
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, _METHODS).withColumns({"attributes": _some("attribute"), "parameter_types": F.array("parameter")})
    return rows.select("id", declarations.entry_kind().alias("entry_kind"))


@query(
    "test_roles",
    f"""WITH m AS ({_METHODS}), t AS (SELECT DISTINCT declaring_type || (id % 50) AS k FROM m WHERE attribute = 'FactAttribute')
SELECT id, coalesce(attribute = 'FactAttribute', false) AS is_test, coalesce(attribute, '') <> 'FactAttribute' AND (coalesce(attribute = 'ClassInitializeAttribute', false) OR name = 'Index') AND declaring_type || (id % 50) IN (SELECT k FROM t) AS is_test_lifecycle FROM m""",
)
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, _METHODS).withColumns({"attributes": _some("attribute"), "declaring_type": F.concat("declaring_type", (F.col("id") % 50).cast("string")), "is_ctor": F.col("name") == "Index", "is_fixture_hook": F.lit(False)})
    return declarations.with_roles(rows).select("id", "is_test", "is_test_lifecycle")


@query("effective_public", "SELECT o_orderkey AS id, o_orderstatus <> 'P' AND o_custkey % 4 <> 0 AS is_public FROM orders")
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT o_orderkey AS id, o_orderstatus <> 'P' AS own, CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN o_custkey % 8 = 0 THEN false END ELSE true END AS outer_one FROM orders")
    return rows.select("id", declarations.effectively_public(F.array("own", "outer_one")).alias("is_public"))


@query("generated_stamps", "SELECT p_partkey AS id, p_size % 2 = 0 AS generated FROM part")
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT p_partkey AS id, concat(p_name, CASE WHEN p_size % 4 = 0 THEN '.G.cs' WHEN p_size % 4 = 2 THEN '.g.cs' ELSE '.cs' END) AS path FROM part")
    return rows.select("id", declarations.is_generated(F.col("path")).alias("generated"))


_ROUTES = """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'HttpPostAttribute' WHEN 1 THEN 'HttpDelete' WHEN 2 THEN 'Obsolete' WHEN 3 THEN 'HttpGetAttribute' END AS first, concat('/f/', o_custkey) AS first_route, CASE o_orderkey % 3 WHEN 0 THEN 'HttpGet' WHEN 1 THEN 'RouteAttribute' END AS second, concat('/s/', o_custkey) AS second_route FROM orders
"""


@query(
    "http_routes",
    f"""SELECT id, CASE WHEN first LIKE 'HttpGet%' OR second LIKE 'HttpGet%' THEN 'GET' WHEN first LIKE 'HttpPost%' THEN 'POST' WHEN first = 'HttpDelete' THEN 'DELETE' END AS verb,
  CASE WHEN first LIKE 'HttpGet%' OR first LIKE 'HttpPost%' THEN first_route WHEN second IS NOT NULL THEN second_route END AS route FROM ({_ROUTES})""",
)
def _(spark, sf_dir):
    usages = F.filter(F.array(F.struct(F.col("first").alias("name"), F.col("first_route").alias("argument")), F.struct(F.col("second").alias("name"), F.col("second_route").alias("argument"))), lambda u: u["name"].isNotNull())
    return facts(spark, sf_dir, _ROUTES).select("id", declarations.http_verb(_some("first", "second")).alias("verb"), declarations.http_route(usages).alias("route"))


# Nodes and structural edges

#: A type a customer, declared in as many parts as the customer has orders.
_SYMBOLS = """
SELECT concat('type:c', c_custkey) AS id, coalesce(o_orderkey, -1) AS seq, CASE WHEN c_custkey % 4 = 0 THEN 'ServiceImplementation' WHEN c_custkey % 4 = 1 THEN 'PageModel' ELSE 'Class' END AS type, concat('Store', c_custkey) AS name, concat('Shop.Store', c_custkey) AS full_name,
  concat('P', c_nationkey % 3) AS project, concat('C', coalesce(o_orderkey, -1), '.cs') AS file_path FROM customer LEFT JOIN orders ON o_custkey = c_custkey
"""
_FIRST = f"SELECT id, min(seq) AS seq, any_value(type) AS type, any_value(name) AS name, any_value(full_name) AS full_name, any_value(project) AS project, arg_min(file_path, seq) AS file_path FROM ({_SYMBOLS}) GROUP BY id"


def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Graph.of(declarations.type_nodes(facts(spark, sf_dir, _SYMBOLS)), spark.createDataFrame([], "edge_seq long, src string, dst string, type string")).nodes


@query("type_nodes", f"SELECT id AS node_id, seq AS node_seq, type, name, file_path FROM ({_FIRST})")
def _(spark, sf_dir):
    return declarations.type_nodes(facts(spark, sf_dir, _SYMBOLS)).select("node_id", "node_seq", "type", "name", "file_path")


_MEMBERS = "SELECT concat('prop:', l_partkey, '.', l_linenumber) AS id, l_orderkey AS seq, concat('type:c', l_suppkey) AS owner, concat('P', l_partkey) AS name, CASE WHEN l_linenumber % 2 = 0 THEN 'Property' ELSE 'Field' END AS kind FROM lineitem"
_MEMBER_FIRST = f"SELECT id, min(seq) AS seq, arg_min(owner, (seq, owner)) AS owner, any_value(name) AS name, any_value(kind) AS kind FROM (SELECT DISTINCT * FROM ({_MEMBERS})) GROUP BY id"


@query("member_nodes", f"SELECT id AS node_id, seq AS node_seq, kind AS type, name FROM ({_MEMBER_FIRST})")
def _(spark, sf_dir):
    return declarations.member_nodes(facts(spark, sf_dir, _MEMBERS), "kind")[0].select("node_id", "node_seq", "type", "name")


@query("decorated_parameters", "SELECT 'param:o' || o_orderkey || '#p' AS node_id, 'm:o' || o_orderkey AS owner, 'Contains' AS type FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT concat('m:o', o_orderkey) AS method, o_orderkey AS seq, 'p' AS name, CASE WHEN o_orderstatus = 'F' THEN 'FromBody' END AS attribute FROM orders").withColumn("attributes", _some("attribute"))
    nodes, edges = declarations.decorated_parameters(rows)
    return edges.join(nodes.select(F.col("node_id").alias("dst")), "dst").select(F.col("dst").alias("node_id"), F.col("src").alias("owner"), "type")


@query("project_nodes", "SELECT 'proj:' || name AS node_id, name, count(k)::VARCHAR AS nodes FROM (SELECT 'P' || r_regionkey AS name FROM region) LEFT JOIN (SELECT c_custkey AS k, 'P' || (c_nationkey % 3) AS p FROM customer) ON p = name GROUP BY ALL")
def _(spark, sf_dir):
    rows = declarations.project_nodes(facts(spark, sf_dir, "SELECT concat('P', r_regionkey) AS name FROM region"), _declared(spark, sf_dir))
    return rows.select("node_id", "name", F.get_json_object("props", "$.nodeCount").alias("nodes"))


@query("project_references", "SELECT DISTINCT 'proj:' || c_nationkey AS src, 'proj:' || s_nationkey AS dst, 'DependsOn' AS type FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey WHERE c_nationkey < 20 AND s_nationkey < 20")
def _(spark, sf_dir):
    uses = facts(spark, sf_dir, "SELECT CAST(c_nationkey AS STRING) AS project, CAST(s_nationkey AS STRING) AS uses FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey")
    return declarations.project_references(uses, facts(spark, sf_dir, "SELECT CAST(n_nationkey AS STRING) AS name FROM nation WHERE n_nationkey < 20"))


@query("projects_without_tests", "SELECT 'P' || n_nationkey AS name FROM nation WHERE n_regionkey <> 2")
def _(spark, sf_dir):
    return declarations.without_tests(facts(spark, sf_dir, "SELECT concat('P', n_nationkey) AS name, CASE WHEN n_regionkey = 2 THEN true WHEN n_regionkey = 1 THEN false END AS is_test_project FROM nation")).select("name")


@query("inheritance_edges", "SELECT DISTINCT 'type:o' || o_orderkey AS src, 'type:c' || o_custkey AS dst, 'Inherits' AS type FROM orders WHERE o_custkey % 4 <> 0")
def _(spark, sf_dir):
    return declarations.inheritance_edges(facts(spark, sf_dir, "SELECT concat('type:o', o_orderkey) AS id, concat('Shop.Store', o_custkey) AS base_type FROM orders"), _declared(spark, sf_dir))


@query(
    "reference_edges",
    """WITH f AS (SELECT 'm:o' || l_orderkey AS src, 'type:c' || c_custkey AS dst, l_orderkey % 2 = 0 AS signature, 'type:c' || (l_orderkey % 10) AS owner FROM lineitem JOIN customer ON c_custkey = l_partkey)
SELECT DISTINCT src, dst, 'References' AS type, signature FROM f WHERE NOT (signature AND dst = owner)""",
)
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT concat('m:o', l_orderkey) AS id, concat('type:c', l_orderkey % 10) AS owner, concat('Shop.Store', l_partkey) AS name, l_orderkey % 2 = 0 AS signature FROM lineitem")
    return declarations.reference_edges(rows.withColumn("names", F.array("name", F.lit("Out.Side"))), _declared(spark, sf_dir))


@query("extension_edges", "SELECT DISTINCT 'm:o' || o_orderkey AS src, 'type:c' || o_custkey AS dst, 'Extends' AS type FROM orders")
def _(spark, sf_dir):
    return declarations.extension_edges(facts(spark, sf_dir, "SELECT concat('m:o', o_orderkey) AS id, CASE WHEN o_orderkey >= 0 THEN concat('Shop.Store', o_custkey) END AS extends FROM orders"), _declared(spark, sf_dir))


@query("implements_edges", "SELECT DISTINCT 'type:c' || o_custkey AS src, 'type:c' || (o_custkey + 1) AS dst, 'Implements' AS type FROM orders JOIN customer ON c_custkey = o_custkey + 1")
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT concat('type:c', o_custkey) AS id, concat('type:c', o_custkey + 1) AS it FROM orders").withColumn("implements_methods", F.array("it", F.lit("gone")))
    return declarations.implements_edges(rows, _declared(spark, sf_dir))


_USAGES = """
SELECT concat('m:o', l_orderkey) AS id, CASE WHEN l_partkey % 2 = 0 THEN concat('Shop.Store', l_partkey % 100) ELSE concat('Out.A', l_partkey % 5, 'Attribute') END AS attribute, concat('A', l_partkey % 5) AS name, 'lib' AS assembly, 'method' AS target, CAST(l_linenumber AS INT) AS line, 'src' AS source, concat('[', l_partkey % 3, ']') AS args FROM lineitem
"""


@query("attribute_edges", f"SELECT DISTINCT id AS src, CASE WHEN attribute LIKE 'Shop.%' THEN 'type:c' || regexp_extract(attribute, '\\d+') ELSE 'ext:' || attribute END AS dst, 'DecoratedBy' AS type, line, args FROM ({_USAGES})")
def _(spark, sf_dir):
    edges = declarations.attribute_edges(facts(spark, sf_dir, _USAGES), _declared(spark, sf_dir))[0]
    return edges.select("src", "dst", "type", "line", F.get_json_object("props", "$.args").alias("args"))


@query("attribute_types", f"SELECT 'ext:' || attribute AS node_id, 'ExternalType' AS type, min(name) AS name, attribute AS full_name FROM ({_USAGES}) WHERE attribute LIKE 'Out.%' GROUP BY attribute")
def _(spark, sf_dir):
    return declarations.attribute_edges(facts(spark, sf_dir, _USAGES), _declared(spark, sf_dir))[1].select("node_id", "type", "name", "full_name")


@query("suppressed_arguments", f"SELECT DISTINCT id AS src, line, CASE WHEN attribute <> 'Out.A1Attribute' THEN args END AS args, attribute FROM ({_USAGES}) WHERE attribute LIKE 'Out.%'")
def _(spark, sf_dir):
    policy = declarations.merged_policy({"suppress_arguments_for": ["Out.A1Attribute"]})
    edges = declarations.attribute_edges(facts(spark, sf_dir, _USAGES), _declared(spark, sf_dir), policy)[0].where("dst like 'ext:%'")
    return edges.select("src", "line", F.get_json_object("props", "$.args").alias("args"), F.substring("dst", 5, 100).alias("attribute"))


@query("register_edges", "SELECT DISTINCT 'type:o' || o_orderkey AS src, 'type:c' || o_custkey AS dst, 'Registers' AS type, 7 AS line FROM orders")
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT concat('type:o', o_orderkey) AS id, 'Reg' AS attribute, 7 AS line, concat('Shop.Store', o_custkey) AS one FROM orders").withColumn("registers", F.array("one", F.lit("Out.X")))
    return declarations.register_edges(rows, _declared(spark, sf_dir)).select("src", "dst", "type", "line")


@query(
    "injection_edges",
    """SELECT DISTINCT 'type:c' || c_custkey AS src, 'type:o' || o_orderkey AS dst, 'InjectedInto' AS type FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 2 = 0 OR c_custkey % 4 = 0""",
)
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT concat('type:o', o_orderkey) AS id, CASE WHEN o_orderkey % 2 = 0 THEN concat('Shop.Store', o_custkey) ELSE concat('Other.IStore', o_custkey) END AS service FROM orders")
    return declarations.injection_edges(rows, _declared(spark, sf_dir))


@query("majority_source", "SELECT tree, arg_max(path, (n, path)) AS path FROM (SELECT o_custkey AS tree, o_orderpriority AS path, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY tree")
def _(spark, sf_dir):
    return declarations.majority_source(facts(spark, sf_dir, "SELECT o_custkey AS tree, o_orderpriority AS path FROM orders"))


@query("callback_stamps", "SELECT 'type:c' || c_custkey AS node_id, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') THEN 'callback' END AS entry_point_kind FROM customer")
def _(spark, sf_dir):
    return folds.callback_stamps(_declared(spark, sf_dir), facts(spark, sf_dir, "SELECT concat('type:c', o_custkey) AS node_id FROM orders WHERE o_orderstatus = 'P'")).select("node_id", "entry_point_kind")


# Lua

_MODULES = "SELECT concat('a.m', p_partkey) AS module, concat('a/m', p_partkey, CASE WHEN p_size < 10 THEN '/init.lua' ELSE '.lua' END) AS path, CASE WHEN p_size < 20 THEN 'plugin' ELSE 'plain' END AS host FROM part"
_REQUIRES = """
SELECT concat('a.m', l_suppkey) AS module, CASE l_linenumber % 4 WHEN 0 THEN concat('a/m', l_partkey, '.lua') WHEN 1 THEN concat('m', l_partkey) WHEN 2 THEN 'Sdk' ELSE 'nope' END AS name, CAST(l_orderkey % 1000 AS INT) AS line, CASE WHEN l_linenumber % 4 = 2 THEN 'import' ELSE 'require' END AS kind FROM lineitem
"""


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lua.resolved_references(facts(spark, sf_dir, _REQUIRES), facts(spark, sf_dir, _MODULES), spark.createDataFrame([("Sdk",)], "module string"))


@query("lua_module_names", "SELECT path, module FROM (" + _MODULES + ")")
def _(spark, sf_dir):
    return facts(spark, sf_dir, _MODULES).select("path", paths.lua_module(F.col("path")).alias("module"))


@query("lua_named_by_rockspec", f"SELECT path, CASE WHEN module LIKE '%7' THEN 'named.' || module ELSE module END AS module FROM ({_MODULES})")
def _(spark, sf_dir):
    rockspec = facts(spark, sf_dir, f"SELECT concat('named.', module) AS module, upper(path) AS path FROM ({_MODULES}) WHERE module LIKE '%7'")
    return paths.lua_modules_of(facts(spark, sf_dir, _MODULES).select("path"), rockspec)


@query("lua_modules", f"SELECT 'mod:' || module AS node_id, 'luaModule' AS kind, module AS name, host FROM ({_MODULES})")
def _(spark, sf_dir):
    return lua.module_nodes(facts(spark, sf_dir, _MODULES)).select("node_id", F.coalesce("foreign_type", "type").alias("kind"), "name", F.get_json_object("props", "$.host").alias("host"))


@query(
    "lua_references",
    """SELECT 'a.m' || l_suppkey AS module, (l_orderkey % 1000)::INT AS line, CASE l_linenumber % 4 WHEN 2 THEN 'external' WHEN 3 THEN 'unresolved' ELSE 'inGraph' END AS outcome, CASE WHEN l_linenumber % 4 < 2 THEN 'a.m' || l_partkey END AS target FROM lineitem""",
)
def _(spark, sf_dir):
    return _references(spark, sf_dir).select("module", "line", "outcome", "target")


#: Functions f0 to f4 of every module; one is declared twice.
_FUNCTIONS = "SELECT concat('a.m', p_partkey) AS module, concat('f', r_regionkey) AS name, CAST(10 * r_regionkey + 1 AS INT) AS line FROM part, region"
_LUA_CALLS = """
SELECT concat('a.m', l_suppkey) AS module, 'main' AS function, CASE l_linenumber WHEN 1 THEN concat('u.f', l_orderkey % 7) WHEN 2 THEN concat('f', l_orderkey % 7) WHEN 3 THEN 'string.sub' WHEN 4 THEN concat('s.run', l_partkey % 9) WHEN 5 THEN 'o:close' WHEN 6 THEN 'print' ELSE 'x.y' END AS callee,
  CASE l_linenumber WHEN 1 THEN 'u' WHEN 3 THEN 'string' WHEN 4 THEN 's' WHEN 5 THEN 'o' WHEN 7 THEN 'x' END AS receiver, CASE l_linenumber WHEN 1 THEN concat('f', l_orderkey % 7) WHEN 3 THEN 'sub' WHEN 4 THEN concat('run', l_partkey % 9) WHEN 5 THEN 'close' WHEN 7 THEN 'y' END AS method, CAST(l_orderkey % 500 AS INT) AS line FROM lineitem
"""
_OUTCOME = """CASE l_linenumber WHEN 1 THEN CASE WHEN l_orderkey % 7 < 5 THEN 'module' ELSE 'unresolved' END WHEN 2 THEN CASE WHEN l_orderkey % 7 < 5 THEN 'sameModule' ELSE 'unresolved' END WHEN 3 THEN 'standard' WHEN 4 THEN 'external' WHEN 5 THEN 'instance' WHEN 6 THEN 'standard' ELSE 'unresolved' END"""


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = facts(spark, sf_dir, "SELECT concat('a.m', s_suppkey) AS module, 'u' AS local, concat('a.m', s_suppkey + 1) AS target, false AS external FROM supplier UNION ALL SELECT concat('a.m', s_suppkey), 's', 'Sdk', true FROM supplier")
    return lua.resolved_calls(facts(spark, sf_dir, _LUA_CALLS), bound, facts(spark, sf_dir, _FUNCTIONS), _catalogue(spark, sf_dir), spark.createDataFrame([("close",)], "method string"))


_CATALOGUE = "SELECT 'Sdk' AS module, concat('run', n_nationkey) AS function, CASE WHEN n_nationkey % 4 = 3 THEN 'unknown' ELSE concat(1 + n_nationkey % 3, '.', n_nationkey) END AS since, CASE WHEN n_nationkey = 2 THEN '9.0' END AS retired, n_nationkey % 2 = 0 AS documented FROM nation WHERE n_nationkey < 7"


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, _CATALOGUE)


@query(
    "lua_calls",
    f"""SELECT 'a.m' || l_suppkey AS module, (l_orderkey % 500)::INT AS line, {_OUTCOME} AS outcome, CASE WHEN l_linenumber = 1 AND l_orderkey % 7 < 5 THEN 'mod:a.m' || (l_suppkey + 1) || '.f' || (l_orderkey % 7) || '#' || (10 * (l_orderkey % 7) + 1)
  WHEN l_linenumber = 2 AND l_orderkey % 7 < 5 THEN 'mod:a.m' || l_suppkey || '.f' || (l_orderkey % 7) || '#' || (10 * (l_orderkey % 7) + 1) WHEN l_linenumber = 4 THEN 'ext:Sdk.run' || (l_partkey % 9) END AS target FROM lineitem""",
)
def _(spark, sf_dir):
    return _calls(spark, sf_dir).select("module", "line", "outcome", "target")


@query("lua_call_report", f"SELECT {_OUTCOME} AS outcome, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return lua.call_report(_calls(spark, sf_dir))


@query("lua_functions", f"SELECT 'mod:' || module || '.' || name || '#' || line AS node_id, name, 'mod:' || module AS declaring_type FROM ({_FUNCTIONS})")
def _(spark, sf_dir):
    return lua.function_nodes(facts(spark, sf_dir, _FUNCTIONS)).select("node_id", "name", "declaring_type")


@query("lua_external_calls", "SELECT 'a.m' || l_suppkey AS module, string_agg(DISTINCT 'Sdk.run' || (l_partkey % 9), ',' ORDER BY 'Sdk.run' || (l_partkey % 9)) AS functions FROM lineitem WHERE l_linenumber = 4 GROUP BY 1")
def _(spark, sf_dir):
    return lua.external_calls(_calls(spark, sf_dir)).select("module", _joined("functions").alias("functions"))


@query("lua_external_nodes", "SELECT DISTINCT 'ext:Sdk.run' || (l_partkey % 9) AS node_id, 'Method' AS type, 'Sdk.run' || (l_partkey % 9) AS name FROM lineitem WHERE l_linenumber = 4")
def _(spark, sf_dir):
    return lua.external_nodes(_calls(spark, sf_dir)).select("node_id", "type", "name")


_USED = "SELECT DISTINCT concat('Sdk.run', p_partkey % 9) AS function FROM part"


@query("catalogue_verdicts", "SELECT DISTINCT 'Sdk.run' || (p_partkey % 9) AS function, CASE WHEN p_partkey % 9 >= 7 THEN 'Unknown' WHEN (p_partkey % 9) % 2 = 0 THEN 'Known' ELSE 'KnownUndocumented' END AS verdict FROM part")
def _(spark, sf_dir):
    return lua.verdicts(facts(spark, sf_dir, _USED), _catalogue(spark, sf_dir))


_USES = "SELECT concat('P', l_suppkey) AS plugin, concat('Sdk.run', l_partkey % 9) AS function FROM lineitem WHERE l_partkey % 9 <> l_suppkey % 9"
_FLOOR = f"""u AS (SELECT DISTINCT plugin, function, since, [split_part(since, '.', 1)::INT, split_part(since, '.', 2)::INT] AS v FROM ({_USES}) JOIN ({_CATALOGUE}) c ON function = 'Sdk.' || c.function WHERE since <> 'unknown'),
floor AS (SELECT plugin, max(v) AS v FROM u GROUP BY 1), floors AS (SELECT plugin, min(since) AS version, string_agg(function, ',' ORDER BY function) AS drivers FROM u JOIN floor USING (plugin, v) GROUP BY 1)"""


@query("version_floors", f"WITH {_FLOOR} SELECT plugin, version, drivers FROM floors".replace("JOIN (" + _CATALOGUE + ") c ON function = 'Sdk.' || c.function", f"b JOIN (SELECT function AS f, since FROM ({_CATALOGUE})) c ON b.function = 'Sdk.' || c.f"))
def _(spark, sf_dir):
    return lua.version_floor(facts(spark, sf_dir, _USES), _catalogue(spark, sf_dir)).select("plugin", "version", _joined("drivers").alias("drivers"))


_MINIMUM = "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Sdk' ELSE concat('Other', p_partkey % 3) END AS module, concat('run', 10 * (p_partkey % 3) + p_partkey % 4) AS function FROM part"


@query("minimum_versions", "SELECT * FROM (VALUES ('Sdk', '3.2'), ('Other1', '4.0')) t(module, version)")
def _(spark, sf_dir):
    return lua.minimum_versions(facts(spark, sf_dir, _MINIMUM), _catalogue(spark, sf_dir), spark.createDataFrame([("Sdk", "1.0"), ("Other1", "4.0")], "module string, since string"))


@query(
    "floors_with_imports",
    """SELECT 'P' || s_suppkey AS plugin, CASE WHEN s_suppkey % 3 = 0 THEN '3.5' ELSE '3.2' END AS version, CASE s_suppkey % 3 WHEN 0 THEN 'Sdk.run5 (3.5)' WHEN 1 THEN 'Sdk (3.2, imported),Sdk.run2 (3.2)' ELSE 'Sdk (3.2, imported)' END AS drivers FROM supplier""",
)
def _(spark, sf_dir):
    imports = facts(spark, sf_dir, "SELECT concat('P', s_suppkey) AS plugin, CASE WHEN s_suppkey % 2 = 0 THEN 'Sdk' ELSE 'Sdk' END AS module FROM supplier")
    uses = facts(spark, sf_dir, "SELECT concat('P', s_suppkey) AS plugin, CASE s_suppkey % 3 WHEN 0 THEN 'Sdk.run5' WHEN 1 THEN 'Sdk.run2' ELSE 'Sdk.run0' END AS function FROM supplier")
    rows = lua.floors_with_imports(imports, uses, _catalogue(spark, sf_dir), spark.createDataFrame([("Sdk", "3.2")], "module string, since string"))
    return rows.select("plugin", "version", _joined("drivers").alias("drivers"))


_REACH = """r(m) AS (SELECT 0::BIGINT UNION SELECT l_partkey FROM r JOIN lineitem ON l_suppkey = m WHERE l_linenumber % 4 < 2 AND m < 5)"""


@query("lua_reachable", f"WITH RECURSIVE {_REACH} SELECT 'a.m' || m AS module FROM r")
def _(spark, sf_dir):
    few = _references(spark, sf_dir).join(facts(spark, sf_dir, "SELECT concat('a.m', s_suppkey) AS module FROM supplier WHERE s_suppkey < 5"), "module", "left_semi")
    return lua.reachable_modules(spark.createDataFrame([("a.m0",)], "module string"), few)


@query("lua_unreachable", f"WITH RECURSIVE {_REACH} SELECT 'sdk.unreachable' AS rule, 'Warning' AS severity, path, 1 AS line FROM ({_MODULES}) WHERE module NOT IN (SELECT 'a.m' || m FROM r)")
def _(spark, sf_dir):
    few = _references(spark, sf_dir).join(facts(spark, sf_dir, "SELECT concat('a.m', s_suppkey) AS module FROM supplier WHERE s_suppkey < 5"), "module", "left_semi")
    return lua.unreachable(facts(spark, sf_dir, _MODULES), spark.createDataFrame([("a.m0",)], "module string"), few).select("rule", "severity", "path", "line")


_REJECTED = "SELECT concat('f', l_suppkey, '.lua') AS path, CAST(l_orderkey AS INT) AS line, concat('no goto at ', l_orderkey) AS message FROM lineitem WHERE l_linenumber = 1"


@query("rule_dialect", "SELECT 'Error' AS severity, 'f' || l_suppkey || '.lua' AS path, min(l_orderkey)::INT AS line, 'no goto at ' || min(l_orderkey) || CASE WHEN count(*) > 1 THEN ' (and ' || (count(*) - 1) || ' more)' ELSE '' END AS message FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey")
def _(spark, sf_dir):
    return lua.dialect(facts(spark, sf_dir, _REJECTED)).select("severity", "path", "line", "message")


@query(
    "rule_sdk_surface",
    f"""WITH u AS (SELECT path, 'Sdk.run' || (l_partkey % 9) AS f, l_partkey % 9 AS k, (l_orderkey % 500)::INT AS line FROM lineitem JOIN ({_MODULES}) ON module = 'a.m' || l_suppkey WHERE l_linenumber = 4)
SELECT 'Error' AS severity, path, min(line) AS line, f || ' was retired in 9.0' AS message FROM u WHERE k = 2 GROUP BY path, f UNION ALL SELECT 'Note', path, min(line), 'not in the catalogue: ' || string_agg(DISTINCT f, ', ' ORDER BY f) FROM u WHERE k >= 7 GROUP BY path""",
)
def _(spark, sf_dir):
    return lua.sdk_surface(_calls(spark, sf_dir), facts(spark, sf_dir, _MODULES), _catalogue(spark, sf_dir)).select("severity", "path", "line", "message")


_ARGUMENTS = "SELECT concat('a', l_suppkey, '.lua') AS path, concat('P', l_suppkey) AS plugin, CAST(l_orderkey % 100 AS INT) AS line, concat('g', l_linenumber) AS function, 1 AS position, concat('v', l_partkey % 5) AS value FROM lineitem"
_ALLOWED = "SELECT concat('g', r_regionkey) AS function, 1 AS position, concat('v', n_nationkey) AS value, concat(1 + n_nationkey, '.5') AS since FROM region, nation WHERE n_nationkey < 4 AND n_nationkey <> r_regionkey"


@query(
    "rule_sdk_arguments",
    """SELECT 'Warning' AS severity, 'a' || l_suppkey || '.lua' AS path, (l_orderkey % 100)::INT AS line, CASE WHEN l_partkey % 5 = 4 OR l_partkey % 5 = l_linenumber THEN 'undocumented value v' || (l_partkey % 5) || ' for g' || l_linenumber ELSE 'v' || (l_partkey % 5) || ' needs ' || (1 + l_partkey % 5) || '.5, the plug-in declares 2.10' END AS message
FROM lineitem WHERE l_linenumber < 5 AND (l_partkey % 5 = 4 OR l_partkey % 5 = l_linenumber OR 1 + l_partkey % 5 > 2)""",
)
def _(spark, sf_dir):
    floors = facts(spark, sf_dir, "SELECT concat('P', s_suppkey) AS plugin, '2.10' AS version FROM supplier")
    return lua.sdk_arguments(facts(spark, sf_dir, _ARGUMENTS), facts(spark, sf_dir, _ALLOWED), floors).select("severity", "path", "line", "message")


_MANIFEST = """
SELECT concat('P', s_suppkey) AS plugin, concat('P', s_suppkey, '/Info.lua') AS path, 'Version' AS key, concat(1 + s_suppkey % 3, '.9') AS value, 3 AS line FROM supplier
UNION ALL SELECT concat('P', s_suppkey), concat('P', s_suppkey, '/Info.lua'), CASE WHEN s_suppkey % 2 = 0 THEN 'Name' ELSE 'Nane' END, 'x', 4 FROM supplier
"""


@query(
    "rule_manifest",
    """SELECT 'Error' AS severity, 'P' || s_suppkey || '/Info.lua' AS path, 1 AS line, 'missing key Name' AS message FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'Note', 'P' || s_suppkey || '/Info.lua', 4, 'unknown keys: Nane' FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT 'Warning', 'P' || s_suppkey || '/Info.lua', 3, 'declares 1.9 but needs 2.10' FROM supplier WHERE s_suppkey % 3 = 0
UNION ALL SELECT 'Warning', 'P' || s_suppkey || '/Info.lua', 3, 'declares 2.9 but needs 2.10' FROM supplier WHERE s_suppkey % 3 = 1""",
)
def _(spark, sf_dir):
    floors = facts(spark, sf_dir, "SELECT concat('P', s_suppkey) AS plugin, '2.10' AS version FROM supplier")
    return lua.manifest_rule(facts(spark, sf_dir, _MANIFEST), ["Name"], ["Name", "Version"], floors, "Version").select("severity", "path", "line", "message")


@query(
    "rule_order",
    f"""WITH d AS (SELECT 'lua.dialect' AS rule, 'Error' AS severity, 'f' || l_suppkey || '.lua' AS path, min(l_orderkey)::INT AS line FROM lineitem WHERE l_linenumber = 1 GROUP BY l_suppkey),
m AS (SELECT 'sdk.manifest' AS rule, severity, path, line FROM (SELECT 'Error' AS severity, 'P' || s_suppkey || '/Info.lua' AS path, 1 AS line FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'Note', 'P' || s_suppkey || '/Info.lua', 4 FROM supplier WHERE s_suppkey % 2 = 1 UNION ALL SELECT 'Warning', 'P' || s_suppkey || '/Info.lua', 3 FROM supplier WHERE s_suppkey % 3 < 2))
SELECT row_number() OVER (ORDER BY CASE severity WHEN 'Error' THEN 1 WHEN 'Warning' THEN 2 ELSE 3 END, path, line, rule) - 1 AS place, rule, severity, path, line FROM (SELECT * FROM d UNION ALL SELECT * FROM m)""",
)
def _(spark, sf_dir):
    floors = facts(spark, sf_dir, "SELECT concat('P', s_suppkey) AS plugin, '2.10' AS version FROM supplier")
    manifest = facts(spark, sf_dir, _MANIFEST)
    found, _ = lua.run_rules([lambda: lua.dialect(facts(spark, sf_dir, _REJECTED)), lambda: lua.manifest_rule(manifest, ["Name"], ["Name", "Version"], floors, "Version"), lambda: manifest.select("none")])
    return _placed(found).select("place", "rule", "severity", "path", "line")


def _placed(rows: DataFrame) -> DataFrame:
    """The rows with their place in the order in which they come: shows in a hash of rows whether the order is right."""
    return rows.coalesce(1).withColumn("place", F.monotonically_increasing_id())


@query("lua_build_counters", "SELECT (SELECT count(*) FROM part) AS files, (SELECT count(*) FROM part) AS modules, (SELECT count(*) * 5 FROM part) AS functions, count(*) FILTER (l_linenumber % 4 < 2) AS in_graph, count(*) FILTER (l_linenumber % 4 = 2) AS external, count(*) FILTER (l_linenumber % 4 = 3) AS unresolved FROM lineitem")
def _(spark, sf_dir):
    rows = lua.build_counters(facts(spark, sf_dir, _MODULES), facts(spark, sf_dir, _FUNCTIONS), _references(spark, sf_dir))
    return rows.withColumnRenamed("inGraph", "in_graph")


@query(
    "lua_hosts",
    "SELECT s_suppkey AS root, CASE s_suppkey % 3 WHEN 0 THEN 'plugin' WHEN 1 THEN 'rock' ELSE 'plain' END AS host, CASE WHEN s_suppkey % 3 = 1 THEN 'b.rockspec' END AS spec FROM supplier",
)
def _(spark, sf_dir):
    files_of = "SELECT s_suppkey AS root, CASE s_suppkey % 3 WHEN 0 THEN 'x/INFO.lua' WHEN 1 THEN 'deep/a.rockspec' ELSE 'c.lua' END AS path FROM supplier UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 1 THEN 'b.rockspec' ELSE 'notinfo.luac' END FROM supplier"
    return lua.host_of(facts(spark, sf_dir, files_of))


@query("rockspec_modules", "SELECT 'a.m' || p_partkey AS module, 'src/m' || p_partkey || '.lua' AS path FROM part")
def _(spark, sf_dir):
    return files.rockspec_modules(facts(spark, sf_dir, """SELECT concat('build = { modules = { ["a.m', p_partkey, '"] = "src/m', p_partkey, '.lua", } }') AS text FROM part"""))


@query("last_segments", "SELECT p_partkey AS id, 'f' || p_size AS last FROM part")
def _(spark, sf_dir):
    return facts(spark, sf_dir, "SELECT p_partkey AS id, concat(CASE p_partkey % 3 WHEN 0 THEN 'a.b.' WHEN 1 THEN 'o:' ELSE '' END, 'f', p_size) AS name FROM part").select("id", paths.last_segment(F.col("name")).alias("last"))


# Bodies

_BLOCKS = """
SELECT concat('b', o_orderkey) AS body, 0 AS ordinal, 'Entry' AS kind, CAST(NULL AS STRING) AS op, CAST(NULL AS STRING) AS callee, CAST(NULL AS STRING) AS condition, CAST(NULL AS INT) AS when_true, CAST(NULL AS INT) AS when_false, CAST(o_orderkey % 3 + 1 AS INT) AS falls_to, 0 AS region FROM orders
UNION ALL SELECT concat('b', o_orderkey), CAST(o_orderkey % 3 + 1 AS INT), 'Block', concat('op', o_custkey % 2), concat('m', o_custkey % 3), 'c', 8, 9, NULL, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END FROM orders
UNION ALL SELECT concat('b', o_orderkey), 8, 'Exit', NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM orders
UNION ALL SELECT concat('b', o_orderkey), 9, 'Exit', NULL, NULL, NULL, NULL, NULL, NULL, 0 FROM orders
"""


@query(
    "body_differences",
    """SELECT a.o_orderkey AS pair, a.o_custkey % 2 = b.o_custkey % 2 AND a.o_custkey % 3 = b.o_custkey % 3 AND (a.o_orderstatus = 'P') = (b.o_orderstatus = 'P') AS equivalent, 3 AS depth_left, CASE WHEN a.o_custkey % 3 <> b.o_custkey % 3 THEN 'm' || (a.o_custkey % 3) ELSE '' END AS only_left, CASE WHEN a.o_custkey % 3 <> b.o_custkey % 3 THEN 'm' || (b.o_custkey % 3) ELSE '' END AS only_right,
  CASE WHEN a.o_custkey % 2 <> b.o_custkey % 2 THEN 'operations' WHEN a.o_custkey % 3 <> b.o_custkey % 3 THEN 'calls' WHEN (a.o_orderstatus = 'P') <> (b.o_orderstatus = 'P') THEN 'exception' END AS first FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1""",
)
def _(spark, sf_dir):
    blocks = facts(spark, sf_dir, _BLOCKS).withColumns({"operations": _some("op"), "calls": _some("callee")}).drop("op", "callee")
    regions = facts(spark, sf_dir, "SELECT concat('b', o_orderkey) AS body, 0 AS id, CAST(NULL AS INT) AS parent, 'Root' AS kind, CAST(NULL AS STRING) AS exception_type FROM orders UNION ALL SELECT concat('b', o_orderkey), 1, 0, 'Catch', 'X' FROM orders")
    pairs = facts(spark, sf_dir, "SELECT a.o_orderkey AS pair, concat('b', a.o_orderkey) AS left, concat('b', b.o_orderkey) AS right FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
    rows = bodies.body_diff(pairs, blocks, regions, facts(spark, sf_dir, "SELECT concat('b', o_orderkey) AS body, 3 AS depth FROM orders"))
    first = F.regexp_extract(F.get("differences", F.lit(0)), r": (\w+)", 1)
    return rows.select("pair", "equivalent", "depth_left", _joined("calls_only_left").alias("only_left"), _joined("calls_only_right").alias("only_right"), first.alias("first"))


# Questions to a graph

_NAMED_NODES = """
SELECT concat('a', c_custkey) AS node_id, c_custkey AS node_seq, CASE WHEN c_custkey % 5 = 0 THEN 'JavaScriptFile' ELSE 'Class' END AS type, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'luaModule' ELSE 'LUAMODULE' END END AS foreign_type, c_name AS name,
  CASE WHEN c_nationkey < 20 THEN concat('P', c_nationkey % 4) END AS project, concat('f', c_custkey % 10, '.cs') AS file_path, CASE WHEN c_custkey % 7 = 0 THEN 'hot' END AS label FROM customer
"""
_NAMED_EDGES = """
SELECT o_orderkey AS edge_seq, concat('a', o_custkey) AS src, concat('a', o_custkey + o_orderkey % 4) AS dst, CASE o_orderkey % 4 WHEN 0 THEN 'Quotes' WHEN 1 THEN 'ViewDataReadBy' WHEN 2 THEN 'Reads' ELSE 'UsesLayout' END AS type, CASE WHEN o_orderstatus = 'P' THEN 'tag' END AS foreign_type,
  CASE o_orderkey % 3 WHEN 0 THEN 'nameof' WHEN 1 THEN 'literal' END AS provenance, CASE WHEN o_orderstatus = 'F' THEN 'v' END AS value, CAST(o_orderkey % 50 AS INT) AS line FROM orders
"""
_NAMED = f"WITH nodes AS ({_NAMED_NODES}), edges AS ({_NAMED_EDGES})"


def _named(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of(facts(spark, sf_dir, _NAMED_NODES).withColumn("labels", _some("label")), facts(spark, sf_dir, _NAMED_EDGES))


@query("nodes_with_label", f"{_NAMED} SELECT node_id FROM nodes WHERE label = 'hot'")
def _(spark, sf_dir):
    return lookup.nodes_with_label(_named(spark, sf_dir), "hot").select("node_id")


@query("nodes_of_foreign_kind", f"{_NAMED} SELECT node_id, type FROM nodes WHERE lower(foreign_type) = 'luamodule'")
def _(spark, sf_dir):
    g = _named(spark, sf_dir)
    return lookup.nodes_of_kind(g, lookup.resolve_kind(g, "LuaModule")).select("node_id", "type")


@query("foreign_kinds", f"{_NAMED} SELECT 'node' AS of, min(foreign_type) AS kind, count(*) AS n FROM nodes WHERE foreign_type IS NOT NULL GROUP BY lower(foreign_type) UNION ALL SELECT 'edge', min(foreign_type), count(*) FROM edges WHERE foreign_type IS NOT NULL GROUP BY lower(foreign_type)")
def _(spark, sf_dir):
    return codec.foreign_data(_named(spark, sf_dir))


@query("foreign_spelling", f"{_NAMED} SELECT arg_min(foreign_type, node_seq) AS kind FROM nodes WHERE foreign_type IS NOT NULL GROUP BY lower(foreign_type)")
def _(spark, sf_dir):
    return spark.createDataFrame([(k,) for k in lookup.foreign_kinds(_named(spark, sf_dir))[0]], "kind string")


@query(
    "quoted_symbols",
    f"""{_NAMED} SELECT e.src, e.dst, coalesce(e.value, b.name) AS value, coalesce(e.provenance, 'literal') AS provenance, e.line FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst
WHERE e.type = 'Quotes' AND coalesce(e.provenance, '') <> 'nameof' AND lower(a.project) = 'p1' AND a.project IS DISTINCT FROM b.project""",
)
def _(spark, sf_dir):
    return lookup.quoted_symbols(_named(spark, sf_dir), "p1").drop("edge_seq")


@query("quoted_symbols_all", f"{_NAMED} SELECT e.src, e.dst, coalesce(e.provenance, 'literal') AS provenance, e.line FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst WHERE e.type = 'Quotes'")
def _(spark, sf_dir):
    return lookup.quoted_symbols(_named(spark, sf_dir), safe=True, same_project=True).select("src", "dst", "provenance", "line")


@query("server_to_script", f"{_NAMED} SELECT e.dst AS script, e.src AS server, e.type AS edge_type FROM edges e JOIN nodes b ON b.node_id = e.dst AND b.type = 'JavaScriptFile' JOIN nodes a ON a.node_id = e.src WHERE e.type IN ('ViewDataReadBy', 'Reads')")
def _(spark, sf_dir):
    return lookup.server_to_script(_named(spark, sf_dir)).select("script", "server", "edge_type")


@query("freshness", f"{_NAMED} SELECT node_id, CASE WHEN file_path = 'f0.cs' THEN true ELSE file_path IN ('f1.cs', 'f3.cs', 'f5.cs', 'f7.cs', 'f9.cs') END AS written_since FROM nodes")
def _(spark, sf_dir):
    from dataclasses import replace
    from datetime import UTC, datetime

    seen = facts(spark, sf_dir, "SELECT DISTINCT concat('f', c_custkey % 10, '.cs') AS path, timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, CAST(c_custkey % 2 AS INT) * 9) AS modified FROM customer WHERE c_custkey % 10 <> 0")
    return files.freshness(replace(_named(spark, sf_dir), built_at=datetime(2024, 1, 5, tzinfo=UTC)), seen)


@query("summaries", f"{_NAMED} SELECT node_id, coalesce(foreign_type, type) AS kind, name, project, file_path FROM nodes")
def _(spark, sf_dir):
    return lookup.summary(_named(spark, sf_dir).nodes).drop("line_start")


@query("node_details", f"{_NAMED} SELECT node_id, coalesce(foreign_type, type) AS kind, name, file_path, CASE WHEN node_seq % 2 = 0 THEN true END AS file_written_since, label AS labels FROM nodes")
def _(spark, sf_dir):
    rows = lookup.detail(_named(spark, sf_dir).nodes, facts(spark, sf_dir, "SELECT concat('a', c_custkey) AS node_id, c_custkey % 2 = 0 AS written_since FROM customer"))
    return rows.select("node_id", "kind", "name", "file_path", "file_written_since", _joined("labels").alias("labels"))


@query("first_declarations", f"{_NAMED} SELECT file_path, arg_min(node_id, (node_seq, node_id)) AS node_id FROM nodes GROUP BY file_path")
def _(spark, sf_dir):
    return lookup.first_declaration(_named(spark, sf_dir).nodes, "file_path").select("file_path", "node_id")


@query(
    "render_tree",
    f"""WITH RECURSIVE nodes AS ({_NAMED_NODES}), e AS (SELECT src, dst FROM ({_NAMED_EDGES}) WHERE type = 'UsesLayout' AND dst IN (SELECT node_id FROM nodes)),
r(node, d) AS (SELECT 'a1', 0 UNION SELECT e.dst, d + 1 FROM r JOIN e ON e.src = r.node WHERE d < 5) SELECT node AS node_id, min(d)::INT AS depth FROM r WHERE node <> 'a1' GROUP BY node""",
)
def _(spark, sf_dir):
    return traverse.render_tree(_named(spark, sf_dir), "a1").select("node_id", "depth")


@query("appended_edges", f"{_NAMED}, n AS (SELECT max(edge_seq) + 1 AS n FROM edges) SELECT edge_seq, src, dst FROM edges UNION ALL SELECT edge_seq + n, dst, src FROM edges, n")
def _(spark, sf_dir):
    g = _named(spark, sf_dir)
    return g.with_edges(g.edges.withColumns({"src": F.col("dst"), "dst": F.col("src")})).edges.select("edge_seq", "src", "dst")


@query("research_of_ids", f"{_NAMED} SELECT src, dst, type FROM edges WHERE src IN ('a1', 'a2', 'a3') AND dst IN ('a1', 'a2', 'a3')")
def _(spark, sf_dir):
    return codec.research_of_ids(_named(spark, sf_dir), ["a1", "a2", "a3"])[1].select("src", "dst", "type")


@query("saved_nodes", f"{_NAMED} SELECT node_id, row_number() OVER (ORDER BY node_seq) - 1 AS node_seq, CASE WHEN foreign_type IS NOT NULL THEN 'Unknown' ELSE type END AS type, foreign_type, name, project, file_path FROM nodes")
def _(spark, sf_dir):
    path = fresh_path(spark, "saved")
    codec.save_graph(_named(spark, sf_dir), path)
    return codec.load_graph(spark, path)[0].nodes.select("node_id", "node_seq", "type", "foreign_type", "name", "project", "file_path")


@query("saved_edges", f"{_NAMED} SELECT row_number() OVER (ORDER BY edge_seq) - 1 AS edge_seq, src, dst, CASE WHEN foreign_type IS NOT NULL THEN 'Unknown' ELSE type END AS type, foreign_type, provenance, line FROM edges")
def _(spark, sf_dir):
    path = fresh_path(spark, "saved")
    codec.save_graph(_named(spark, sf_dir), path)
    return codec.load_graph(spark, path)[0].edges.select("edge_seq", "src", "dst", "type", "foreign_type", "provenance", "line")


@query(
    "page_context",
    """SELECT 'page' AS page, 'pm0' AS model, (SELECT string_agg(s_name, ',' ORDER BY s_name) FROM supplier) AS services, 'BigShopView' AS view_model""",
)
def _(spark, sf_dir):
    nodes = """SELECT 'page' AS node_id, 0 AS node_seq, 'RazorPage' AS type, 'P' AS name, 'Shop' AS model_type UNION ALL SELECT 'pm', 1, 'PageModel', 'pm0', NULL UNION ALL SELECT 'vm', 5, 'ViewModel', 'BigShopView', NULL UNION ALL SELECT 'cl', 2, 'Class', 'ShopClass', NULL
UNION ALL SELECT concat('svc', s_suppkey), 10 + s_suppkey, 'ServiceImplementation', s_name, NULL FROM supplier"""
    edges = "SELECT 1 AS edge_seq, 'page' AS src, 'pm' AS dst, 'PageServedBy' AS type UNION ALL SELECT 2 + s_suppkey, concat('svc', s_suppkey), 'pm', 'InjectedInto' FROM supplier"
    rows = lookup.page_context(Graph.of(facts(spark, sf_dir, nodes), facts(spark, sf_dir, edges)), "page")
    return rows.select("page", "model", _joined("services").alias("services"), "view_model")


@query(
    "refusals",
    """SELECT * FROM (VALUES ('edge kind', true), ('entry kind', true), ('known entry kind', false), ('kind in another case', false), ('kind of no one', true), ('neither of two', true), ('no tests', true), ('node', true), ('one of two', false), ('two of two', true)) t("case", refused)""",
)
def _(spark, sf_dir):
    g = _named(spark, sf_dir)
    cases = {
        "no tests": lambda: lookup.require_tests(g), "node": lambda: lookup.require_node(g, "nobody"), "entry kind": lambda: lookup.require_entry_kind("nonsense"), "known entry kind": lambda: lookup.require_entry_kind("main"),
        "kind in another case": lambda: lookup.resolve_kind(g, "cLASS"), "kind of no one": lambda: lookup.resolve_kind(g, "Nope"), "edge kind": lambda: lookup.resolve_kind(g, "Nope", "edge"), "two of two": lambda: lookup.require_one(a=1, b=2),
        "one of two": lambda: lookup.require_one(a=1, b=None), "neither of two": lambda: lookup.require_any(a=None, b=None),
    }

    def refused(ask) -> bool:
        try:
            ask()
        except lookup.Refusal:
            return True
        return False

    return spark.createDataFrame([(name, refused(ask)) for name, ask in cases.items()], "case string, refused boolean")
