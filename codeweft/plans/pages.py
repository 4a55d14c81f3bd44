"""Registered queries over pages, scripts, views and shapes, with SQL that knows the answer from the row a text was made of."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..model import Graph
from ..operators import binding, client, declarations
from ..sources import files
from ..store import settled
from .sources import PAGES, SCRIPTS, facts, texts
from .suite import query

_joined = partial(F.array_join, delimiter=",")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.page_facts(texts(spark, sf_dir, PAGES))


def _scanned(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Facts that several steps read: every page is scanned once."""
    return settled(_pages(spark, sf_dir).select("id", "path", *columns), "pages")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.script_facts(texts(spark, sf_dir, SCRIPTS))


def _graph(spark: SparkSession, sf_dir: str, nodes: str) -> Graph:
    return Graph.of(facts(spark, sf_dir, nodes), spark.createDataFrame([], "edge_seq long, src string, dst string, type string"))


# Scanners


@query(
    "page_facts",
    """SELECT 'page:' || c_custkey AS id, true AS is_page, '/c/' || c_custkey AS route, 'Shop.M' || c_nationkey AS model_type, '_L' || (c_custkey % 2) AS layout, 'Scripts' AS sections, 'IStore' || c_nationkey || ' Store' AS injects, 'T' || (c_custkey % 5) AS keys,
  '~/js/s' || (c_custkey % 97) || '.js?v=1,/css/' || (c_custkey % 4) || '.css' AS assets, 'let a = ' || c_custkey || ';' AS inline, 'key' || (c_custkey % 6) || ',fixed' AS data_keys, 'key' || (c_custkey % 6) AS bound_keys,
  'd' || (c_custkey % 13) || ',P_Q_' || (c_custkey % 3) AS ids, 1 AS dynamic_ids, '_Part' || (c_custkey % 9) || ':10:true,_Other:10:false' AS partials, 'input:9' AS tags FROM customer
UNION ALL SELECT 'page:_Part' || n_nationkey, false, NULL, NULL, NULL, '', '', '', '', '', 'inner' || n_nationkey, 'inner' || n_nationkey, 'part' || n_nationkey, 0, '', '' FROM nation""",
)
def _(spark, sf_dir):
    return _pages(spark, sf_dir).select(
        "id", "is_page", "route", "model_type", "layout", _joined("sections").alias("sections"), _joined("injects").alias("injects"), _joined("view_data_keys").alias("keys"), _joined("assets").alias("assets"), _joined("inline").alias("inline"), _joined("data_keys").alias("data_keys"),
        _joined("bound_keys").alias("bound_keys"), _joined("ids").alias("ids"), "dynamic_ids", _joined(F.transform("partials", lambda p: F.concat_ws(":", p["name"], p["line"], p["is_tag"]))).alias("partials"), _joined(F.transform("tag_helpers", lambda t: F.concat_ws(":", t["tag"], t["line"]))).alias("tags"),
    )


@query(
    "page_nodes",
    """SELECT 'page:' || c_custkey AS node_id, 'RazorPage' AS type, 'P' || c_custkey AS name, 'Shop.M' || c_nationkey AS model_type, '/c/' || c_custkey AS route, 1 AS scripts FROM customer
UNION ALL SELECT 'page:_Part' || n_nationkey, 'PartialView', '_Part' || n_nationkey, NULL, NULL, 0 FROM nation""",
)
def _(spark, sf_dir):
    return client.page_nodes(_pages(spark, sf_dir)).select("node_id", "type", "name", "model_type", F.get_json_object("props", "$.routeTemplate").alias("route"), F.get_json_object("props", "$.inlineScriptCount").cast("int").alias("scripts"))


@query(
    "script_facts",
    """SELECT 'js:s' || p_partkey AS id, 6 - 1 - CASE WHEN p_size < 10 THEN 1 ELSE 1 END AS line_count, 'key' || (p_partkey % 6) || ',camel-case' || (p_partkey % 4) || ',own' || (p_partkey % 3) AS data_keys, 'own' || (p_partkey % 3) AS written,
  'key' || (p_partkey % 6) || ',camel-case' || (p_partkey % 4) AS read_only, 'd' || (p_partkey % 13) || ',lost' || (p_partkey % 5) AS ids, CASE WHEN p_size < 10 THEN 1 ELSE 0 END AS dynamic_selectors, '/api/' || p_brand || '/1?x=2' AS api FROM part""",
)
def _(spark, sf_dir):
    return _scripts(spark, sf_dir).select("id", "line_count", _joined("data_keys").alias("data_keys"), _joined("data_keys_written").alias("written"), _joined("read_only_keys").alias("read_only"), _joined("selector_ids").alias("ids"), "dynamic_selectors", _joined("api_calls").alias("api"))


_VENDOR = """
SELECT p_partkey AS id, concat(CASE p_partkey % 9 WHEN 0 THEN 'lib/' WHEN 1 THEN '@scope/' WHEN 2 THEN 'Drop/' WHEN 3 THEN 'kit/in/' WHEN 4 THEN 'mylib/' WHEN 5 THEN 'js/NODE_MODULES/' ELSE 'js/' END, p_name, CASE WHEN p_size < 20 THEN '.min' ELSE '' END, '.js') AS path FROM part
"""
_VENDOR_SQL = f"""WITH facts AS ({_VENDOR}), part_of AS (SELECT f.id, f.path, p_size FROM facts f JOIN part ON p_partkey = f.id),
reasons AS (SELECT id, path, CASE id % 9 WHEN 0 THEN 'vendor directory ''lib''' WHEN 1 THEN 'npm scope ''@scope''' WHEN 2 THEN 'package drop ''Drop''' WHEN 3 THEN 'package manifest in ''kit''' WHEN 5 THEN 'vendor directory ''NODE_MODULES''' ELSE CASE WHEN p_size < 20 THEN 'minified' END END AS reason FROM part_of)"""


@query("vendor_reasons", f"{_VENDOR_SQL} SELECT id, path, reason FROM reasons")
def _(spark, sf_dir):
    return facts(spark, sf_dir, _VENDOR).select("id", "path", paths.vendor_reason(F.col("path"), ["drop"], ["kit"]).alias("reason"))


@query("vendor_skips", f"{_VENDOR_SQL} SELECT reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY 1")
def _(spark, sf_dir):
    return files.skip_summary(facts(spark, sf_dir, _VENDOR).select("path", paths.vendor_reason(F.col("path"), ["drop"], ["kit"]).alias("reason")).where("reason is not null"))


# What pages load and render


@query(
    "page_partials",
    """SELECT 'page:' || c_custkey AS src, 'page:_Part' || (c_custkey % 9) AS dst, 10 AS line, 'true' AS tag FROM customer UNION ALL SELECT 'page:' || c_custkey, 'partial:_Other', 10, 'false' FROM customer""",
)
def _(spark, sf_dir):
    pages = _scanned(spark, sf_dir, "partials")
    edges, _ = client.partial_edges(pages, pages.select("id", "path"))
    return edges.select("src", "dst", "line", F.get_json_object("props", "$.isTagHelper").alias("tag"))


@query("partial_stubs", "SELECT 'partial:_Other' AS node_id, 'PartialView' AS type, '_Other' AS name FROM region LIMIT 1")
def _(spark, sf_dir):
    pages = _scanned(spark, sf_dir, "partials")
    return client.partial_edges(pages, pages.select("id", "path"))[1]


_LOADS = "SELECT c_custkey AS k, c_custkey % 97 AS s FROM customer JOIN part ON p_partkey = c_custkey % 97"


@query("page_scripts_loaded", f"SELECT 'page:' || k AS page, 'js:s' || s AS script FROM ({_LOADS})")
def _(spark, sf_dir):
    return client.loaded_scripts(_pages(spark, sf_dir), facts(spark, sf_dir, SCRIPTS))


@query("inline_scripts", """SELECT 'js:' || c_custkey || '#inline-1' AS node_id, 'JavaScriptFile' AS type, 'true' AS inline, '1' AS lines FROM customer""")
def _(spark, sf_dir):
    rows = client.asset_nodes(client.inline_scripts(_pages(spark, sf_dir)).withColumn("vendor_reason", F.lit(None).cast("string")))
    return rows.select("node_id", "type", F.get_json_object("props", "$.inline").alias("inline"), F.get_json_object("props", "$.lineCount").alias("lines"))


@query("asset_nodes", "SELECT 'js:s' || p_partkey AS node_id, 'JavaScriptFile' AS type, 's' || p_partkey || '.js' AS name, 'js/s' || p_partkey || '.js' AS file_path, '4' AS lines FROM part")
def _(spark, sf_dir):
    rows = client.asset_nodes(facts(spark, sf_dir, SCRIPTS).withColumn("vendor_reason", F.lit(None).cast("string")))
    return rows.select("node_id", "type", "name", "file_path", F.get_json_object("props", "$.lineCount").alias("lines"))


def _scopes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scopes, and the pages they are of."""
    pages = _scanned(spark, sf_dir, "partials", "assets", "dynamic_ids", *client.NAMES)
    return client.composed_scopes(pages, client.partial_edges(pages, pages.select("id", "path"))[0]), pages


@query(
    "composed_scopes",
    """SELECT 'page:' || c_custkey AS page, 'fixed,inner' || (c_custkey % 9) || ',key' || (c_custkey % 6) AS data_keys, 'inner' || (c_custkey % 9) || ',key' || (c_custkey % 6) AS bound_keys, 'P_Q_' || (c_custkey % 3) || ',d' || (c_custkey % 13) || ',part' || (c_custkey % 9) AS ids, 1 AS dynamic_ids FROM customer
UNION ALL SELECT 'page:_Part' || n_nationkey, 'inner' || n_nationkey, 'inner' || n_nationkey, 'part' || n_nationkey, 0 FROM nation""",
)
def _(spark, sf_dir):
    return _scopes(spark, sf_dir)[0].select("page", _joined("data_keys").alias("data_keys"), _joined("bound_keys").alias("bound_keys"), _joined("ids").alias("ids"), F.col("dynamic_ids").cast("int").alias("dynamic_ids"))


@query(
    "script_coupling",
    f"""SELECT 'page:' || k AS src, 'js:s' || s AS dst, 'ViewDataReadBy' AS type, '{{"dataKeys":["key' || (k % 6) || '"]}}' AS props FROM ({_LOADS}) WHERE k % 6 = s % 6
UNION ALL SELECT 'page:' || k, 'js:s' || s, 'DomSelectedBy', '{{"ids":["d' || (k % 13) || '"]}}' FROM ({_LOADS}) WHERE k % 13 = s % 13""",
)
def _(spark, sf_dir):
    scripts, (scopes, pages) = settled(_scripts(spark, sf_dir), "scripts"), _scopes(spark, sf_dir)
    return client.coupling_edges(scopes, client.loaded_scripts(pages, scripts.select("id", "path")), scripts)


_RENDERED = f"""l AS ({_LOADS}),
keys AS (SELECT s, unnest(['fixed', 'inner' || (k % 9), 'key' || (k % 6)]) AS x FROM l), ids AS (SELECT s, unnest(['P_Q_' || (k % 3), 'd' || (k % 13), 'part' || (k % 9)]) AS x FROM l)"""


@query(
    "rendered_names",
    f"""WITH {_RENDERED} SELECT 'js:s' || a.s AS script, a.x AS data_keys, b.x AS ids, true AS dynamic FROM (SELECT s, string_agg(DISTINCT x, ',' ORDER BY x) AS x FROM keys GROUP BY s) a JOIN (SELECT s, string_agg(DISTINCT x, ',' ORDER BY x) AS x FROM ids GROUP BY s) b USING (s)""",
)
def _(spark, sf_dir):
    scopes, pages = _scopes(spark, sf_dir)
    rows = client.rendered_for(scopes, client.loaded_scripts(pages, facts(spark, sf_dir, SCRIPTS)))
    return rows.select("script", _joined(F.array_sort("data_keys")).alias("data_keys"), _joined(F.array_sort("ids")).alias("ids"), "dynamic")


@query(
    "unbound_names",
    f"""WITH {_RENDERED} SELECT 'js:s' || s AS script, 'camel-case' || (s % 4) || CASE WHEN 'key' || (s % 6) IN (SELECT x FROM keys WHERE keys.s = o.s) THEN '' ELSE ',key' || (s % 6) END AS keys, '' AS ids FROM (SELECT DISTINCT s FROM l) o""",
)
def _(spark, sf_dir):
    scripts, (scopes, pages) = settled(_scripts(spark, sf_dir), "scripts"), _scopes(spark, sf_dir)
    rows = client.unbound_names(scopes, client.loaded_scripts(pages, scripts.select("id", "path")), scripts)
    return rows.select("script", _joined("keys").alias("keys"), _joined("ids").alias("ids"))


@query("api_calls", """SELECT 'js:s' || p_partkey AS src, 'ctrl:0' AS dst, 'Calls' AS type, '/api/' || p_brand || '/1?x=2' AS url FROM part""")
def _(spark, sf_dir):
    nodes = _graph(spark, sf_dir, "SELECT concat('ctrl:', r_regionkey) AS node_id, r_regionkey AS node_seq, 'ApiController' AS type, CASE WHEN r_regionkey = 3 THEN 'Brand' ELSE 'brandCONTROLLER' END AS name FROM region").nodes
    return client.api_edges(_scripts(spark, sf_dir), nodes).select("src", "dst", "type", F.get_json_object("props", "$.url").alias("url"))


_MODELS = """
SELECT concat('pm:', n_nationkey) AS node_id, n_nationkey AS node_seq, CASE WHEN n_nationkey % 2 = 0 THEN 'PageModel' ELSE 'Class' END AS type, concat('M', n_nationkey) AS name, concat('Shop.M', n_nationkey) AS full_name FROM nation
UNION ALL SELECT concat('again:', n_nationkey), 100 + n_nationkey, 'Class', concat('M', n_nationkey), concat('Shop.M', n_nationkey) FROM nation
UNION ALL SELECT concat('layout:', r_regionkey), 1000 + r_regionkey, 'PartialView', concat('_L', r_regionkey), NULL FROM region
"""


@query(
    "page_symbol_links",
    """SELECT 'page:' || c_custkey AS src, 'pm:' || c_nationkey AS dst, 'PageServedBy' AS type FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT 'pm:' || c_nationkey, 'page:' || c_custkey, 'ReturnsView' FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT 'page:' || c_custkey, CASE WHEN c_nationkey % 2 = 1 THEN 'pm:' ELSE 'again:' END || c_nationkey, 'HasModel' FROM customer
UNION ALL SELECT 'page:' || c_custkey, 'layout:' || (c_custkey % 2), 'UsesLayout' FROM customer""",
)
def _(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("id", "model_type", "layout", F.lit(None).cast("string").alias("page_model"))
    return declarations.page_links(pages, _graph(spark, sf_dir, _MODELS).nodes)


@query("tag_helper_nodes", """SELECT 'th:page:' || c_custkey || ':9' AS node_id, 'TagHelperInvocation' AS type, 'input asp-for="P.Q[' || (c_custkey % 3) || ']"' AS name, 9 AS line_start, 'P.Q[' || (c_custkey % 3) || ']' AS property FROM customer""")
def _(spark, sf_dir):
    rows = client.tag_helpers(_pages(spark, sf_dir), _graph(spark, sf_dir, _MODELS).nodes)[0]
    return rows.select("node_id", "type", "name", "line_start", F.get_json_object("props", "$.property").alias("property"))


@query("tag_helper_edges", "SELECT 'page:' || c_custkey AS src, 'th:page:' || c_custkey || ':9' AS dst, 'RendersComponent' AS type FROM customer UNION ALL SELECT 'th:page:' || c_custkey || ':9', 'pm:' || c_nationkey, 'BindsTo' FROM customer")
def _(spark, sf_dir):
    return client.tag_helpers(_pages(spark, sf_dir), _graph(spark, sf_dir, _MODELS).nodes)[1]


@query("compiled_links", """SELECT 'page:' || c_custkey AS src, 'type:g' || o_orderkey AS dst, 'References' AS type FROM customer JOIN orders ON o_custkey = c_custkey""")
def _(spark, sf_dir):
    symbols = facts(spark, sf_dir, "SELECT concat('type:g', o_orderkey) AS id, concat('PAGES/', c_nationkey, '/p', c_custkey, '.CSHTML') AS generated_from FROM orders JOIN customer ON c_custkey = o_custkey")
    return declarations.compiled_links(facts(spark, sf_dir, PAGES).select("id", "path"), symbols).select("src", "dst", "type")


# Views and shapes

_TEMPLATES = """
SELECT concat('v:', n_nationkey) AS id, concat('Views/C', n_nationkey, '/Edit.cshtml') AS path, concat('P', n_regionkey) AS project FROM nation
UNION ALL SELECT concat('sh:', r_regionkey), concat('Views/Shared/_Card', r_regionkey, '.cshtml'), concat('P', r_regionkey) FROM region
UNION ALL SELECT concat('pg:', n_nationkey), concat('Pages/', n_nationkey, '/_Card0.cshtml'), concat('P', n_regionkey) FROM nation
UNION ALL SELECT concat('odd:', r_regionkey), concat('Odd/', r_regionkey, '/Lone.cshtml'), concat('P', r_regionkey) FROM region
"""
_CALLS = """
SELECT concat('m:', o_orderkey) AS method, o_orderkey % 7 AS call, CASE o_orderkey % 7 WHEN 0 THEN 'Edit' WHEN 1 THEN concat('_Card', o_custkey % 7) WHEN 2 THEN 'lone' WHEN 3 THEN concat('~/Views/Shared/_Card', o_custkey % 5, '.cshtml') WHEN 4 THEN 'Nope' WHEN 5 THEN '_Card0' END AS name,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('C', o_custkey % 25) END AS controller, CASE WHEN o_orderkey % 7 = 5 THEN concat('Pages/', o_custkey % 25, '/Index.cshtml') END AS source, CAST(o_orderkey % 100 AS INT) AS line FROM orders
"""


@query(
    "view_resolution",
    """SELECT 'm:' || o_orderkey AS method, CASE o_orderkey % 7 WHEN 0 THEN 'Views/C' || (o_custkey % 25) || '/Edit.cshtml' WHEN 1 THEN CASE WHEN o_custkey % 7 < 5 THEN 'Views/Shared/_Card' || (o_custkey % 7) || '.cshtml' END WHEN 2 THEN 'Odd/0/Lone.cshtml'
  WHEN 3 THEN 'Views/Shared/_Card' || (o_custkey % 5) || '.cshtml' WHEN 5 THEN 'Pages/' || (o_custkey % 25) || '/_Card0.cshtml' END AS path FROM orders WHERE o_orderkey % 7 IN (0, 2, 3, 5) OR (o_orderkey % 7 = 1 AND o_custkey % 7 < 5)""",
)
def _(spark, sf_dir):
    rows = paths.resolve_views(facts(spark, sf_dir, _CALLS).where("name is not null"), facts(spark, sf_dir, _TEMPLATES), ["method"])
    return rows.where("rank = 0").select("method", "path")


_RETURNED = """SELECT 'm:' || o_orderkey AS src, CASE o_orderkey % 7 WHEN 0 THEN 'v:' || (o_custkey % 25) WHEN 1 THEN 'sh:' || (o_custkey % 7) WHEN 2 THEN 'odd:0' WHEN 3 THEN 'sh:' || (o_custkey % 5) ELSE 'sh:0' END AS dst, (o_orderkey % 100)::INT AS line FROM orders
  WHERE o_orderkey % 7 IN (0, 2, 3, 5) OR (o_orderkey % 7 = 1 AND o_custkey % 7 < 5)"""


@query("returned_views", f"SELECT src, dst, 'ReturnsView' AS type, line FROM ({_RETURNED})")
def _(spark, sf_dir):
    return binding.view_edges(facts(spark, sf_dir, _CALLS), facts(spark, sf_dir, _TEMPLATES))[0].select("src", "dst", "type", "line")


@query(
    "view_findings",
    """SELECT 'm:' || o_orderkey AS method, CASE o_orderkey % 7 WHEN 4 THEN 'Nope' WHEN 1 THEN '_Card' || (o_custkey % 7) ELSE '' END AS missing, CASE WHEN o_orderkey % 7 = 6 THEN 1 ELSE 0 END::BIGINT AS unresolved FROM orders WHERE o_orderkey % 7 IN (4, 6) OR (o_orderkey % 7 = 1 AND o_custkey % 7 >= 5)""",
)
def _(spark, sf_dir):
    return binding.view_edges(facts(spark, sf_dir, _CALLS), facts(spark, sf_dir, _TEMPLATES))[1].select("method", _joined("missing").alias("missing"), "unresolved")


@query(
    "helper_renders",
    f"""WITH r AS ({_RETURNED}) SELECT 'm:' || a.o_orderkey AS src, r.dst, r.src AS via FROM r JOIN orders h ON r.src = 'm:' || h.o_orderkey AND h.o_orderstatus <> 'F' JOIN orders a ON a.o_orderkey + 1 = h.o_orderkey AND a.o_orderstatus = 'F'""",
)
def _(spark, sf_dir):
    edges = binding.view_edges(facts(spark, sf_dir, _CALLS), facts(spark, sf_dir, _TEMPLATES))[0]
    calls = facts(spark, sf_dir, "SELECT concat('m:', o_orderkey) AS src, concat('m:', o_orderkey + 1) AS dst, 'Calls' AS type FROM orders")
    actions = facts(spark, sf_dir, "SELECT concat('m:', o_orderkey) AS method FROM orders WHERE o_orderstatus = 'F'")
    return binding.helper_renders(edges, calls, actions).select("src", "dst", F.get_json_object("props", "$.via").alias("via"))


@query(
    "shape_candidates",
    """SELECT DISTINCT 'W' || p_size || '_Summary__' || p_type || '__B' AS name, 'W' || p_size || '-' || p_type || '-B.Summary,W' || p_size || '-' || p_type || '.Summary,W' || p_size || '.Summary,W' || p_size || '-' || p_type || '-B,W' || p_size || '-' || p_type || ',W' || p_size || ',W' || p_size || '_Summary__' || p_type || '__B' AS candidates FROM part""",
)
def _(spark, sf_dir):
    rows = facts(spark, sf_dir, "SELECT DISTINCT concat('W', p_size, '_Summary__', p_type, '__B') AS name FROM part")
    return rows.select("name", _joined(paths.shape_candidates(F.col("name"))).alias("candidates"))


_MENTIONS = """
SELECT concat('Menu', p_size % 10, CASE WHEN p_partkey % 2 = 0 THEN concat('__', p_type) ELSE '' END) AS name, concat('m:', p_partkey) AS made_by, p_partkey % 3 = 0 AS is_alternate, p_partkey % 5 = 0 AS in_test, CAST(p_partkey % 50 AS INT) AS line FROM part
"""
_SHAPES = f"SELECT name, coalesce(string_agg(DISTINCT made_by, ',' ORDER BY made_by) FILTER (NOT is_alternate AND NOT in_test), '') AS required_by FROM ({_MENTIONS}) GROUP BY 1"


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts(spark, sf_dir, _MENTIONS).withColumnRenamed("made_by", "by")


@query("shape_nodes", f"SELECT 'shape:' || name AS node_id, 'NamedBinding' AS type, name, required_by FROM ({_SHAPES})")
def _(spark, sf_dir):
    return binding.shape_nodes(_mentions(spark, sf_dir)).select("node_id", "type", "name", _joined("required_by").alias("required_by"))


@query("produced_shapes", f"SELECT DISTINCT made_by AS src, 'shape:' || name AS dst, 'Produces' AS type, line, is_alternate AS alternate, in_test AS test FROM ({_MENTIONS})")
def _(spark, sf_dir):
    rows = binding.produce_edges(_mentions(spark, sf_dir))
    return rows.select("src", "dst", "type", "line", F.get_json_object("props", "$.isAlternate").cast("boolean").alias("alternate"), F.get_json_object("props", "$.inTestCode").cast("boolean").alias("test"))


_SHAPE_FILES = """
SELECT concat('t:', n_nationkey) AS id, concat('V/Menu', n_nationkey % 10, CASE WHEN n_nationkey < 10 THEN '' ELSE '-PROMO' END, '.cshtml') AS path, concat('P', n_regionkey) AS project FROM nation
"""
_BOUND = f"""f AS ({_SHAPE_FILES}), s AS (SELECT DISTINCT name FROM ({_MENTIONS})),
c AS (SELECT s.name, f.id, CASE WHEN contains(s.name, '__') THEN CASE WHEN f.path = 'V/' || replace(s.name, '__', '-') || '.cshtml' THEN 0 WHEN f.path = 'V/' || regexp_replace(s.name, '__.*', '') || '.cshtml' THEN 1 END WHEN f.path = 'V/' || s.name || '.cshtml' THEN 0 END AS pos FROM s, f)"""


def _bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = binding.shape_nodes(_mentions(spark, sf_dir)).select("name", F.array(F.lit("P0")).alias("projects"))
    return binding.shape_bindings(shapes, facts(spark, sf_dir, _SHAPE_FILES))


@query("shape_bindings", f"WITH {_BOUND} SELECT name, id AS template, row_number() OVER (PARTITION BY name ORDER BY pos, id)::INT - 1 AS rank FROM c WHERE pos IS NOT NULL")
def _(spark, sf_dir):
    return _bindings(spark, sf_dir).select("name", "template", "rank")


@query(
    "bound_edges",
    f"""WITH {_BOUND} SELECT 'shape:' || name AS src, c.id AS dst, 'BoundBy' AS type, (row_number() OVER (PARTITION BY name ORDER BY pos, c.id) - 1)::VARCHAR AS rank, 'razor' AS kind, CASE WHEN pos = 1 THEN regexp_replace(name, '__.*', '') ELSE replace(name, '__', '-') END AS matched FROM c WHERE pos IS NOT NULL""",
)
def _(spark, sf_dir):
    rows = binding.bound_edges(_bindings(spark, sf_dir), facts(spark, sf_dir, _SHAPE_FILES))
    value = lambda k: F.get_json_object("props", f"$.{k}")
    return rows.select("src", "dst", "type", value("rank").alias("rank"), value("bindingKind").alias("kind"), value("matchedAs").alias("matched"))


@query("shape_bindings_seen", f"WITH {_BOUND} SELECT name, id AS template, row_number() OVER (PARTITION BY name ORDER BY pos, id)::INT - 1 AS rank FROM c JOIN f USING (id) WHERE pos IS NOT NULL AND project IN ('P0', 'P1')")
def _(spark, sf_dir):
    shapes = binding.shape_nodes(_mentions(spark, sf_dir)).select("name", F.array(F.lit("P0")).alias("projects"))
    seen = binding.visible_projects(facts(spark, sf_dir, "SELECT concat('P', r_regionkey) AS name FROM region"), facts(spark, sf_dir, "SELECT concat('P', r_regionkey) AS src, concat('P', r_regionkey + 1) AS dst FROM region"))
    return binding.shape_bindings(shapes, facts(spark, sf_dir, _SHAPE_FILES), seen).select("name", "template", "rank")


@query("visible_projects", "SELECT 'P' || r_regionkey AS project, 'P' || r_regionkey AS sees FROM region UNION ALL SELECT 'P' || r_regionkey, 'P' || (r_regionkey + 1) FROM region")
def _(spark, sf_dir):
    return binding.visible_projects(facts(spark, sf_dir, "SELECT concat('P', r_regionkey) AS name FROM region"), facts(spark, sf_dir, "SELECT concat('P', r_regionkey) AS src, concat('P', r_regionkey + 1) AS dst FROM region UNION ALL SELECT concat('P', r_regionkey), concat('P', r_regionkey) FROM region"))


#: A placement file a nation: comments, a last comma, a rule that hides a shape for all and one that doesn't.
_PLACEMENTS = """
SELECT concat('p', n_nationkey, '.json') AS path, concat('{ // Menu0: not here', chr(10), ' "Menu', n_nationkey % 10, '__STANDARD": [ {"place": "-"', CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE ', "contentType": "X"' END, '} ], /* "Menu1": [] */', chr(10), chr(10),
  ' "Other', n_nationkey, '": [ {"place": "Content:', n_nationkey, '", "differentiator": "D", "alternates": "Alt', n_nationkey, '", "wrappers": ["Wrap"], "shape": "New', n_nationkey, '"}, ] }') AS text FROM nation
"""


@query(
    "placement_rules",
    """SELECT 'p' || n_nationkey || '.json' AS path, 'Menu' || (n_nationkey % 10) || '__STANDARD' AS shape, 2 AS line, '-' AS place, NULL AS differentiator, NULL AS renamed_to, '' AS alternates, true AS hides, n_nationkey % 2 = 0 AS unconditional FROM nation
UNION ALL SELECT 'p' || n_nationkey || '.json', 'Other' || n_nationkey, 4, 'Content:' || n_nationkey, 'D', 'New' || n_nationkey, 'Alt' || n_nationkey, false, false FROM nation""",
)
def _(spark, sf_dir):
    return files.placements(facts(spark, sf_dir, _PLACEMENTS)).select("path", "shape", "line", "place", "differentiator", "renamed_to", _joined("alternates").alias("alternates"), "hides", "unconditional")


@query("placement_mentions", "SELECT unnest(['Alt' || n_nationkey, 'Wrap', 'New' || n_nationkey]) AS name, 'placement:p' || n_nationkey || '.json' AS by, unnest([true, false, false]) AS is_alternate, 4 AS line FROM nation")
def _(spark, sf_dir):
    return binding.placement_mentions(files.placements(facts(spark, sf_dir, _PLACEMENTS))).select("name", "by", "is_alternate", "line")


@query("placement_nodes", "SELECT 'placement:p' || n_nationkey || '.json' AS node_id, 'ConfigurationFile' AS type, 'p' || n_nationkey || '.json' AS name FROM nation")
def _(spark, sf_dir):
    return binding.placement_nodes(files.placements(facts(spark, sf_dir, _PLACEMENTS))).select("node_id", "type", "name")


@query("placement_edges", "SELECT 'placement:p' || n_nationkey || '.json' AS src, 'shape:' || unnest(['Menu' || (n_nationkey % 10) || '__STANDARD', 'Other' || n_nationkey]) AS dst, unnest(['-', 'Content:' || n_nationkey]) AS place, unnest(['true', 'false']) AS hides FROM nation")
def _(spark, sf_dir):
    rows = binding.placement_edges(files.placements(facts(spark, sf_dir, _PLACEMENTS)))
    return rows.select("src", "dst", F.get_json_object("props", "$.place").alias("place"), F.get_json_object("props", "$.hides").alias("hides"))


_VERDICTS = f"""{_BOUND}, v AS (SELECT s.name, s.required_by, CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.name = s.name AND pos IS NOT NULL) THEN 'bound' WHEN s.name IN (SELECT 'Menu' || (n_nationkey % 10) || '__STANDARD' FROM nation WHERE n_nationkey % 2 = 0) THEN 'renderSuppressed' WHEN s.required_by = '' THEN 'noRequiredProducer' ELSE 'unbound' END AS verdict FROM ({_SHAPES}) s)"""


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Templates of the shapes with a second part alone, so that every verdict comes up.
    templates = facts(spark, sf_dir, _SHAPE_FILES).where("path like '%PROMO%'")
    shapes = binding.shape_nodes(_mentions(spark, sf_dir))
    bound = binding.shape_bindings(shapes.withColumn("projects", F.array(F.lit("P0"))), templates)
    return binding.shape_verdicts(shapes, bound, files.placements(facts(spark, sf_dir, _PLACEMENTS)))


_VERDICTS = _VERDICTS.replace(f"f AS ({_SHAPE_FILES})", f"f AS (SELECT * FROM ({_SHAPE_FILES}) WHERE path LIKE '%PROMO%')")


@query("shape_verdicts", f"WITH {_VERDICTS} SELECT name, verdict, required_by FROM v")
def _(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("name", "verdict", _joined("required_by").alias("required_by"))


@query(
    "build_findings",
    f"""WITH {_VERDICTS} SELECT 'unboundShape' AS kind, name AS subject, replace(required_by, ',', ', ') AS detail FROM v WHERE verdict = 'unbound'
UNION ALL SELECT 'missingViews', 'm:' || o_orderkey, CASE o_orderkey % 7 WHEN 4 THEN 'Nope' ELSE '_Card' || (o_custkey % 7) END FROM orders WHERE o_orderkey % 7 = 4 OR (o_orderkey % 7 = 1 AND o_custkey % 7 >= 5)
UNION ALL SELECT 'unresolvedViews', 'm:' || o_orderkey, '1' FROM orders WHERE o_orderkey % 7 = 6""",
)
def _(spark, sf_dir):
    return binding.findings(_verdicts(spark, sf_dir), binding.view_edges(facts(spark, sf_dir, _CALLS), facts(spark, sf_dir, _TEMPLATES))[1])
