"""Registered queries over the supplied tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan
from ..model import Graph, flag, kind, upsert
from ..operators import folds, lookup, traverse
from ..operators.coverage import coverage, coverage_of, covered_methods
from ..operators.escapes import escape_edges
from ..operators.visibility import excess_visibility
from ..projection import CTES, LAYER_CTES, STEP, graph, layered_graph

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
WITH = f"WITH {CTES}"
RECURSIVE = f"WITH RECURSIVE {CTES}"
LAYERS = f"WITH RECURSIVE {LAYER_CTES}"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def over_graph(name: str, sql: str | None = None):
    """A query of a graph alone."""

    def add(f):
        query(name, sql)(lambda spark, sf_dir: f(graph(spark, sf_dir)))
        return f

    return add


def covered(g: Graph, covers: DataFrame) -> Graph:
    """The graph with these Covers edges; coverage has no depth bound, as in the reference."""
    covers = covers.withColumn("type", F.lit("Covers")).withColumn("edge_seq", F.lit(9 * STEP) + F.xxhash64(*[c for c in covers.columns if c in ("src", "dst")]).bitwiseAND(F.lit((1 << 39) - 1)))
    return Graph.of(g.nodes, g.edges.unionByName(Graph.of(g.nodes, covers).edges))


def over_layers(name: str, sql: str | None = None):
    """A query of the layered graph alone."""

    def add(f):
        query(name, sql)(lambda spark, sf_dir: f(layered_graph(spark, sf_dir)))
        return f

    return add


#: The whole closure: the recursion ends where no further step leads.
_COVER = """
steps AS (SELECT src, dst FROM edges WHERE type = 'Calls' UNION ALL SELECT dst, src FROM edges WHERE type = 'Implements'),
reach(test, node, d) AS (
  SELECT * FROM (SELECT node_id AS test, node_id AS node, 0 AS d FROM nodes WHERE is_test UNION ALL SELECT t.node_id, h.node_id, 0 FROM nodes t JOIN nodes h ON h.declaring_type = t.declaring_type WHERE t.is_test AND h.is_test_lifecycle)
  UNION SELECT r.test, s.dst, r.d + 1 FROM reach r JOIN steps s ON s.src = r.node),
covers AS (
  SELECT r.test AS src, r.node AS dst, min(r.d) AS depth FROM reach r JOIN nodes n ON n.node_id = r.node JOIN nodes t ON t.node_id = r.test
  WHERE r.d > 0 AND n.type = 'Method' AND NOT n.is_test AND NOT n.is_test_lifecycle AND n.project <> t.project GROUP BY 1, 2)
"""


# Filters


@over_graph("point_lookup", f"{WITH} SELECT node_id, type, name, project FROM nodes WHERE node_id = 'm:o10'")
def _(g):
    return lookup.node(g, "m:o10").select("node_id", "type", "name", "project")


@over_graph("nodes_of_kind", f"{WITH} SELECT node_id, name FROM nodes WHERE type = 'Class'")
def _(g):
    return lookup.nodes_of_kind(g, "cLaSs").select("node_id", "name")


@over_graph("nodes_of_kind_named", f"{WITH} SELECT node_id, name FROM nodes WHERE type = 'Method' AND contains(lower(name), 'order12')")
def _(g):
    return lookup.nodes_of_kind(g, "method", "ORDER12").select("node_id", "name")


@over_graph("nodes_by_name", f"{WITH} SELECT node_id, type FROM nodes WHERE contains(lower(name), '001')")
def _(g):
    return lookup.nodes_by_name(g, "001").select("node_id", "type")


@over_graph("project_scope", f"{WITH} SELECT node_id FROM nodes WHERE lower(project) = 'asia'")
def _(g):
    return lookup.in_project(g.nodes, "Asia").select("node_id")


@over_graph("deep_methods", f"{WITH} SELECT node_id, body_depth FROM nodes WHERE type = 'Method' AND coalesce(body_depth, 0) >= 6")
def _(g):
    return lookup.deep_methods(g, 6).select("node_id", "body_depth")


@query("property_bag", "SELECT event_id, coalesce(TRY_CAST(json_extract(props, '$.k') AS BIGINT), 0) AS k FROM events")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", F.coalesce(F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint"), F.lit(0)).alias("k"))


@over_layers("uncovered_methods", f"{LAYERS}, {_COVER} SELECT node_id FROM nodes WHERE type = 'Method' AND NOT is_test AND NOT is_abstract AND lower(project) = 'europe' AND node_id NOT IN (SELECT dst FROM covers)")
def _(g):
    return lookup.uncovered_methods(covered(g, covered_methods(g)), "EUROPE").select("node_id")


# One hop


@over_graph("neighbours", f"{WITH} SELECT n.node_id, n.name FROM edges e JOIN nodes n ON n.node_id = e.dst WHERE e.src = 'm:o10' AND e.type IN ('Calls', 'Reads')")
def _(g):
    return lookup.neighbours(g, "m:o10", ["Calls", "Reads"]).select("node_id", "name")


@over_graph("predecessors", f"{WITH} SELECT n.node_id, n.name FROM edges e JOIN nodes n ON n.node_id = e.src WHERE e.dst = 'type:c10' AND e.type = 'InjectedInto'")
def _(g):
    return lookup.predecessors(g, "type:c10", ["InjectedInto"]).select("node_id", "name")


@over_graph(
    "node_detail",
    f"{WITH} SELECT d.direction, d.other, n.name, d.edge_type FROM (SELECT 'out' AS direction, dst AS other, type AS edge_type FROM edges WHERE src = 'm:o10' UNION ALL SELECT 'in', src, type FROM edges WHERE dst = 'm:o10') d LEFT JOIN nodes n ON n.node_id = d.other",
)
def _(g):
    return lookup.node_detail(g, "m:o10").select("direction", "other", "name", "edge_type")


@over_layers("covering_tests", f"{LAYERS}, {_COVER} SELECT src AS test, depth::INT AS depth FROM covers WHERE dst = (SELECT min(dst) FROM covers)")
def _(g):
    first = covered_methods(g).agg(F.min("dst")).first()[0]
    return lookup.covering_tests(covered(g, coverage_of(g, first)), first).select(F.col("node_id").alias("test"), "depth")


@over_layers("covered_methods", f"{LAYERS}, {_COVER} SELECT dst AS method, depth FROM covers WHERE src = (SELECT min(node_id) FROM nodes WHERE is_test)")
def _(g):
    first = g.nodes.where(flag("is_test")).agg(F.min("node_id")).first()[0]
    return lookup.covered_methods(covered(g, coverage(g, test=first)), first).select(F.col("node_id").alias("method"), "depth")


# Traversal

_FLOW = "', '".join(traverse.FLOW_KINDS)


def _walk(start: str, k: int, kinds: str, where: str = "src", to: str = "dst", free: bool = True) -> str:
    cost = "CASE WHEN e.type = 'Contains' THEN 0 ELSE 1 END" if free else "1"
    return f"""{RECURSIVE},
e AS (SELECT {where} AS a, {to} AS b, type FROM edges WHERE type IN ('{kinds}') AND {to} IN (SELECT node_id FROM nodes)),
r(node, d) AS (SELECT '{start}', 0 UNION SELECT e.b, r.d + {cost} FROM r JOIN e ON e.a = r.node WHERE r.d + {cost} <= {k})
SELECT node AS node_id, min(d)::INT AS depth FROM r WHERE node <> '{start}' GROUP BY node"""


@over_graph("trace_data_flow", _walk("type:c5", 3, _FLOW))
def _(g):
    return traverse.trace_data_flow(g, "type:c5", 3).select("node_id", "depth")


@over_graph("trace_incoming", _walk("prop:p5", 3, _FLOW, "dst", "src"))
def _(g):
    return traverse.trace_data_flow(g, "prop:p5", 3, "incoming").select("node_id", "depth")


@over_graph("traverse_calls", _walk("m:o3", 12, "Calls", free=False))
def _(g):
    return traverse.traverse(g, "m:o3", ["Calls"], 12).select("node_id", "depth")


@over_graph(
    "traverse_both",
    f"""{RECURSIVE}, e AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'DependsOn' UNION ALL SELECT dst, src FROM edges WHERE type = 'DependsOn'),
r(node, d) AS (SELECT 'proj:ASIA', 0 UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.node WHERE r.d < 2) SELECT node AS node_id, min(d)::INT AS depth FROM r WHERE node <> 'proj:ASIA' GROUP BY node""",
)
def _(g):
    return traverse.traverse(g, "proj:ASIA", ["DependsOn"], 2, "both").select("node_id", "depth")


@over_graph(
    "find_path",
    f"""{RECURSIVE}, e AS (SELECT src AS a, dst AS b FROM edges WHERE type = 'Calls'),
r(node, d) AS (SELECT 'm:o3', 0 UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.node WHERE r.d < 8) SELECT min(d)::BIGINT AS hops FROM r WHERE node = 'm:o38'""",
)
def _(g):
    path = traverse.find_path(g, "m:o3", "m:o38", ["Calls"])
    return path.agg(F.count("*").alias("hops"))


@over_graph(
    "relevance",
    f"""{RECURSIVE}, e AS (SELECT src AS a, dst AS b FROM edges WHERE dst IN (SELECT node_id FROM nodes)),
r(node, d) AS (SELECT * FROM (VALUES ('m:o1', 0), ('m:o20', 0)) UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.node WHERE r.d < 3) SELECT node AS node_id, 1.0::DOUBLE / (1 + min(d)) AS relevance FROM r GROUP BY node""",
)
def _(g):
    return traverse.relevance(g, ["m:o1", "m:o20", "nope"])[0]


@over_graph(
    "research_edges",
    f"""{RECURSIVE}, e AS (SELECT src AS a, dst AS b FROM edges WHERE dst IN (SELECT node_id FROM nodes)),
r(node, d) AS (SELECT 'm:o1', 0 UNION SELECT e.b, r.d + 1 FROM r JOIN e ON e.a = r.node WHERE r.d < 2) SELECT src, dst, type FROM edges WHERE src IN (SELECT node FROM r) AND dst IN (SELECT node FROM r)""",
)
def _(g):
    return traverse.research(g, ["m:o1"], 3, 0.33)[1].select("src", "dst", "type")


# Fixed points


@over_layers("coverage", f"{LAYERS}, {_COVER} SELECT src, dst, depth::INT AS depth FROM covers")
def _(g):
    return coverage(g).select("src", "dst", "depth")


_CHAIN = """chain(rem, type, anc) AS (VALUES (0, 'CustomException', 'CustomException'), (0, 'CustomException', 'InvalidOperationException'), (0, 'CustomException', 'SystemException'), (0, 'CustomException', 'Exception'),
  (1, 'InvalidOperationException', 'InvalidOperationException'), (1, 'InvalidOperationException', 'SystemException'), (1, 'InvalidOperationException', 'Exception'),
  (2, 'ArgumentException', 'ArgumentException'), (2, 'ArgumentException', 'SystemException'), (2, 'ArgumentException', 'Exception'))"""
_ESCAPES = f"""{RECURSIVE},
{_CHAIN},
calls AS (SELECT src, dst, guard % 8 AS g FROM edges WHERE type = 'Calls'),
steps AS (SELECT c.src, c.dst, t.type,
    (g = 0 OR (g = 1 AND t.type IN (SELECT type FROM chain WHERE anc = 'InvalidOperationException'))) AS stop,
    ((g = 2 AND t.type IN (SELECT type FROM chain WHERE anc = 'CustomException')) OR (g = 5 AND t.type IN (SELECT type FROM chain WHERE anc = 'SystemException'))) AS maybe
  FROM calls c, (SELECT DISTINCT type FROM chain) t),
f(method, type, conditional) AS (
  SELECT 'm:o' || o_orderkey, c.type, false FROM orders JOIN (SELECT DISTINCT rem, type FROM chain) c ON c.rem = o_orderkey % 3 WHERE o_orderstatus = 'F'
  UNION SELECT s.src, f.type, f.conditional OR s.maybe FROM f JOIN steps s ON s.dst = f.method AND s.type = f.type WHERE NOT s.stop),
best AS (SELECT method, type, bool_and(conditional) AS conditional FROM f GROUP BY 1, 2)
"""


@over_graph("escapes", f"{_ESCAPES} SELECT b.method AS entry, b.type AS exception_type, b.conditional FROM best b JOIN nodes n ON n.node_id = b.method WHERE n.entry_point_kind IS NOT NULL")
def _(g):
    return escape_edges(g).select(F.col("dst").alias("entry"), "exception_type", "conditional")


@over_graph(
    "escapes_report",
    f"{_ESCAPES} SELECT b.method AS entry, b.type AS exception_type, n.entry_point_kind AS entry_kind FROM best b JOIN nodes n ON n.node_id = b.method WHERE n.entry_point_kind = 'pageHandler' AND lower(n.project) = 'asia' AND contains(lower(b.type), 'custom')",
)
def _(g):
    g = Graph.of(g.nodes, escape_edges(g).withColumn("edge_seq", F.lit(0)))
    return lookup.escapes_report(g, "pageHandler", "custom", "asia").select("entry", "exception_type", "entry_kind")


@over_layers(
    "boundary_escapes",
    f"""{LAYERS}, {_CHAIN},
names(type, chain) AS (SELECT type, list(anc) FROM chain GROUP BY type),
flow AS (
  SELECT c.src AS entry, CASE t.thrown WHEN 0 THEN 'CustomException' WHEN 1 THEN 'InvalidOperationException' ELSE 'ArgumentException' END AS type, t.node_id AS thrower, c.guard AS g
  FROM nodes t JOIN edges i ON i.src = t.node_id AND i.type = 'Implements' JOIN edges c ON c.dst = i.dst AND c.type = 'Calls' WHERE t.thrown IS NOT NULL),
facts AS (
  SELECT f.entry, f.type, f.thrower, (f.g = 2 AND list_contains(n.chain, 'CustomException')) OR (f.g = 5 AND list_contains(n.chain, 'SystemException')) AS conditional
  FROM flow f JOIN names n USING (type) WHERE NOT (f.g = 1 AND list_contains(n.chain, 'InvalidOperationException'))),
best AS (SELECT entry, type, first(thrower ORDER BY conditional, thrower) AS thrower, bool_and(conditional) AS conditional FROM facts GROUP BY 1, 2),
hit AS (
  SELECT n.type, b.node_id AS border, coalesce(b.firm = '*' OR list_contains(n.chain, b.firm), false) AS sure FROM names n JOIN nodes b
  ON b.firm = '*' OR list_contains(n.chain, b.firm) OR b.maybe = '*' OR list_contains(n.chain, b.maybe)),
lists AS (SELECT type, string_agg(border, ',' ORDER BY border) FILTER (sure) AS firm, string_agg(border, ',' ORDER BY border) FILTER (NOT sure) AS maybe FROM hit GROUP BY 1)
SELECT b.thrower, b.entry, b.type AS exception_type, 1 AS depth, b.thrower || '>' || b.entry AS path, b.conditional, CASE WHEN e.entry_point_kind <> 'eventHandler' THEN l.firm END AS intercepted_by, CASE WHEN e.entry_point_kind <> 'eventHandler' THEN l.maybe END AS intercepted_conditionally_by
FROM best b JOIN nodes e ON e.node_id = b.entry LEFT JOIN lists l ON l.type = b.type WHERE e.entry_point_kind IS NOT NULL""",
)
def _(g):
    return escape_edges(g).select(
        F.col("src").alias("thrower"), F.col("dst").alias("entry"), "exception_type", "depth", F.array_join("path", ">").alias("path"), "conditional",
        F.array_join("intercepted_by", ",").alias("intercepted_by"), F.array_join("intercepted_conditionally_by", ",").alias("intercepted_conditionally_by"),
    )


@over_graph("excess_visibility")
def _(g):
    return excess_visibility(g, "ASIA").select("node_id", "kind", "name", F.array_join("consumed_by", ",").alias("consumed_by"))


# Aggregates and folds


@over_graph("census", f"{WITH} SELECT type AS kind, count(*) AS n FROM nodes GROUP BY 1")
def _(g):
    return lookup.census(g)


@over_graph("edge_census", f"{WITH} SELECT type AS kind, count(*) AS n FROM edges GROUP BY 1")
def _(g):
    return lookup.edge_census(g)


@over_graph("nodes_per_project", f"{WITH} SELECT project, count(*) AS n FROM nodes GROUP BY 1")
def _(g):
    return lookup.nodes_per_project(g)


@over_graph("unique_names", f"{WITH} SELECT name, min(node_id) AS node_id FROM nodes WHERE type NOT IN ('Project', 'Parameter') AND NOT starts_with(name, '.') GROUP BY name HAVING count(*) = 1")
def _(g):
    return lookup.unique_names(g)


@over_graph("callers", f"{WITH} SELECT dst, array_to_string(list_sort(list(DISTINCT src)), ',') AS callers FROM edges WHERE type = 'Calls' GROUP BY dst")
def _(g):
    return lookup.callers(g).select("dst", F.array_join("callers", ",").alias("callers"))


@over_graph("test_projects", f"{WITH} SELECT DISTINCT lower(project) AS project FROM nodes WHERE is_test")
def _(g):
    return lookup.test_projects(g)


@over_graph("consumers", f"{WITH} SELECT e.dst AS node_id, array_to_string(list_sort(list(DISTINCT n.project)), ',') AS consumed_by FROM edges e JOIN nodes n ON n.node_id = e.src JOIN nodes t ON t.node_id = e.dst GROUP BY 1")
def _(g):
    from ..operators.visibility import consumers

    return consumers(g).select("node_id", F.array_join("consumed_by", ",").alias("consumed_by"))


@over_graph(
    "call_fold",
    f"""{WITH}, s AS (SELECT src, dst, CASE guard % 8 WHEN 0 THEN '*' WHEN 1 THEN 'InvalidOperationException' ELSE '' END AS g FROM edges WHERE type = 'Calls')
SELECT src, dst, CASE WHEN count(*) FILTER (g <> '*') = 0 THEN '*' WHEN count(DISTINCT g) FILTER (g <> '*') = 1 THEN min(g) FILTER (g <> '*') ELSE '' END AS guarded_by FROM s GROUP BY src, dst""",
)
def _(g):
    sites = g.edges.where("type = 'Calls'").select("src", "dst", "guarded_by", "filtered_by", "via_delegate")
    return folds.call_edges(sites, g.nodes).select("src", "dst", F.coalesce(F.array_join("guarded_by", ","), F.lit("")).alias("guarded_by"))


@query(
    "access_fold",
    """SELECT DISTINCT 'm:o' || l_orderkey AS src, 'prop:p' || l_partkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'Writes' ELSE 'Reads' END AS type FROM lineitem""",
)
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return folds.access_edges(rows.select(F.concat(F.lit("m:o"), "l_orderkey").alias("src"), F.concat(F.lit("prop:p"), "l_partkey").alias("dst"), (F.col("l_returnflag") != "R").alias("is_read"), (F.col("l_returnflag") == "R").alias("is_write")))


@over_graph("thrown_types", "SELECT 'm:o' || o_orderkey AS method, CASE o_orderkey % 3 WHEN 0 THEN 'CustomException' WHEN 1 THEN 'InvalidOperationException' ELSE 'ArgumentException' END AS type, false AS conditional FROM orders WHERE o_orderstatus = 'F'")
def _(g):
    return folds.thrown_types(g.nodes.where("throws is not null").select(F.col("node_id").alias("method"), F.explode("throws").alias("t")).select("method", "t.type", "t.conditional"))


@query(
    "quote_edges",
    """WITH names AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS t FROM benchmark) WHERE length(t) >= 3),
uniq AS (SELECT t, min(item_id) AS item_id FROM names GROUP BY t HAVING count(*) = 1),
q AS (SELECT DISTINCT doc_id, t FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\\p{L}]+')) AS t FROM documents))
SELECT 'doc:' || doc_id AS src, 'name:' || t AS dst, t AS value FROM q JOIN uniq USING (t)""",
)
def _(spark, sf_dir):
    words = lambda t, i: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, F.explode(F.array_distinct(F.split("text", r"[^\p{L}]+"))).alias("t"))
    names = words("benchmark", "item_id").where(F.length("t") >= 3)
    nodes = names.select(F.concat(F.lit("name:"), "t").alias("node_id"), F.col("item_id").alias("node_seq"), F.lit("Class").alias("type"), F.col("t").alias("name"))
    quotes = words("documents", "doc_id").select(F.concat(F.lit("doc:"), "doc_id").alias("src"), F.col("t").alias("value"), F.lit("literal").alias("provenance"), F.lit(1).alias("line"))
    return folds.quote_edges(Graph.of(nodes, spark.createDataFrame([], "edge_seq long")), quotes).select("src", "dst", "value")


@over_graph("upsert_nodes", f"{WITH} SELECT node_id, CASE WHEN type = 'Class' THEN 'again' ELSE name END AS name FROM nodes")
def _(g):
    again = g.nodes.where("type = 'Class'").withColumn("name", F.lit("again")).withColumn("node_seq", F.col("node_seq") + F.lit(9 * STEP))
    return upsert(g.nodes.unionByName(again)).select("node_id", "name")


@over_graph("summary_page", f"{WITH} SELECT (SELECT count(*) FROM nodes WHERE type = 'Class') AS total_matches, 50 AS returned, true AS truncated")
def _(g):
    rows, envelope = lookup.page(lookup.nodes_of_kind(g, "Class").orderBy("node_id"))
    return rows.agg(F.count("*").cast("int").alias("returned")).select(F.lit(envelope["totalMatches"]).cast("long").alias("total_matches"), "returned", F.lit(envelope["truncated"]).alias("truncated"))


# Pages


@query("page_scripts", r"SELECT page_id, len(regexp_extract_all(html, '(?i)<script(?:[^>]*)>'))::INT AS inline_scripts FROM pages")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.size(scan.inline_scripts(F.col("html"))).alias("inline_scripts"))


@query(
    "page_links",
    r"""SELECT page_id, CASE WHEN h = '' OR starts_with(h, 'http:') OR starts_with(h, 'https:') OR starts_with(h, '//') THEN NULL ELSE ltrim(regexp_replace(regexp_replace(h, '[?#].*$', ''), '^~', ''), '/') END AS target, count(*) AS n
FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) AS h FROM pages) GROUP BY ALL""",
)
def _(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?i)<a\s[^>]*?href\s*=\s*"([^"]*)"'), F.lit(1))).alias("h"))
    return rows.groupBy("page_id", scan.asset_path(F.col("h")).alias("target")).agg(F.count("*").alias("n"))


@query("kebab_names", r"SELECT DISTINCT c_name AS name, lower(regexp_replace(c_name, '(\p{Lu})', '-\1', 'g')) AS kebab FROM customer")
def _(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), scan.kebab(F.col("c_name")).alias("kebab")).distinct()
