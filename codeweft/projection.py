"""The supplied star-schema tables as code graphs, for Spark and, with the same rules, as SQL.

The shop graph: regions are projects, customers classes, orders methods, parts properties, suppliers
services; an order calls its customer's next order and the order seven numbers on, reads and writes
the parts of its line items, and some throw.

The layered graph: orders, some of them tests, call the parts of their line items, which are interface
methods that suppliers implement; suppliers throw and call their nation, nations their region.
Customers have a set-up hook. Attributes and the regions' calls lead to ids without a node.

A graph is derived once a session, written in the native form (edges by kind) and read by all queries;
it is derived anew when its input files change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Graph
from .sources.codec import read_tables, write_tables
from .store import fresh_path

STEP = 10**12

_PROJECTS = """
SELECT concat('proj:', r_name) AS node_id, r_regionkey AS k, 0 AS fam, 'Project' AS type, r_name AS name, r_name AS project,
  CAST(NULL AS STRING) AS declaring_type, false AS is_public, false AS is_test, false AS is_abstract, CAST(NULL AS INT) AS body_depth, CAST(NULL AS STRING) AS entry_point_kind
FROM region
UNION ALL
SELECT concat('type:c', c_custkey), c_custkey, 1, 'Class', c_name, r_name, NULL, c_acctbal > 0, false, false, NULL, NULL
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('svc:s', s_suppkey), s_suppkey, 2, 'ServiceImplementation', s_name, r_name, NULL, true, false, false, NULL, NULL
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('m:o', o_orderkey), o_orderkey, 3, 'Method', concat('Order', o_orderkey), r_name, concat('type:c', o_custkey), o_totalprice > 100000,
  o_orderpriority = '1-URGENT', o_orderstatus = 'P', CAST(lines AS INT),
  CASE o_orderpriority WHEN '2-HIGH' THEN 'pageHandler' WHEN '3-MEDIUM' THEN 'eventHandler' WHEN '5-LOW' THEN 'main' END
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
LEFT JOIN (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey
UNION ALL
SELECT concat('prop:p', p_partkey), p_partkey, 4, 'Property', p_name, r_name, concat('type:c', p_partkey), true, false, false, NULL, NULL
FROM part JOIN region ON p_partkey % 5 = r_regionkey
"""

_EDGES = """
SELECT 1 AS fam, o_orderkey AS k, concat('type:c', o_custkey) AS src, concat('m:o', o_orderkey) AS dst, 'Contains' AS type, o_orderkey AS guard FROM orders
UNION ALL
SELECT 2, p_partkey, concat('type:c', p_partkey), concat('prop:p', p_partkey), 'Contains', 0 FROM part JOIN customer ON p_partkey = c_custkey
UNION ALL
SELECT 3, o_orderkey, concat('m:o', o_orderkey), concat('m:o', following), 'Calls', o_orderkey
FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS following FROM orders) WHERE following IS NOT NULL
UNION ALL
SELECT 4, a.o_orderkey, concat('m:o', a.o_orderkey), concat('m:o', b.o_orderkey), 'Calls', a.o_orderkey FROM orders a JOIN orders b ON a.o_orderkey + 7 = b.o_orderkey
UNION ALL
SELECT 5, l_orderkey * 10 + l_linenumber, concat('m:o', l_orderkey), concat('prop:p', l_partkey), CASE WHEN l_returnflag = 'R' THEN 'Writes' ELSE 'Reads' END, 0 FROM lineitem
UNION ALL
SELECT 6, s * 1000000 + c, concat('svc:s', s), concat('type:c', c), 'InjectedInto', 0
FROM (SELECT DISTINCT l_suppkey AS s, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
UNION ALL
SELECT 7, l_orderkey * 10 + l_linenumber, concat('m:o', l_orderkey), concat('type:c', l_partkey), 'References', 0 FROM lineitem JOIN customer ON l_partkey = c_custkey WHERE l_linenumber = 1
UNION ALL
SELECT 8, a.r_regionkey, concat('proj:', a.r_name), concat('proj:', b.r_name), 'DependsOn', 0 FROM region a JOIN region b ON a.r_regionkey + 1 = b.r_regionkey
"""

#: Exception types by order number: each with its ancestors, nearest first.
CHAINS = {
    0: ("CustomException", "InvalidOperationException", "SystemException", "Exception"),
    1: ("InvalidOperationException", "SystemException", "Exception"),
    2: ("ArgumentException", "SystemException", "Exception"),
}
#: Guards of a call by the caller's number modulo 8.
GUARDS = {0: ("*",), 1: ("InvalidOperationException",)}
FILTERS = {2: ("CustomException",), 5: ("SystemException",)}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: For the SQL twins: WITH nodes, edges.
CTES = f"nodes AS ({_PROJECTS.replace('AS STRING', 'AS VARCHAR')}), edges AS ({_EDGES})"


def _views(spark: SparkSession, sf_dir: str) -> str:
    """Named inline so that no view of the session is touched."""
    return ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"WITH {_views(spark, sf_dir)} {_PROJECTS}")
    chain = F.create_map(*[x for r, c in CHAINS.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])
    own = chain[(F.col("k") % 3).cast("int")]
    throws = F.when((F.col("fam") == 3) & F.col("throwing"), F.array(F.struct(own[0].alias("type"), own.alias("chain"), F.lit(False).alias("conditional"))))
    failed = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.concat(F.lit("m:o"), "o_orderkey").alias("node_id"), F.lit(True).alias("throwing"))
    return rows.join(failed, "node_id", "left").withColumn("throws", throws).withColumn("node_seq", F.col("fam") * F.lit(STEP) + F.col("k")).drop("fam", "k", "throwing")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark.sql(f"WITH {_views(spark, sf_dir)} {_EDGES}"))


def _guarded(rows: DataFrame) -> DataFrame:
    """Edges with the guards and filters that the number of a call gives it."""
    calls = F.col("type") == "Calls"

    def by(table: dict, modulo: int):
        return F.when(calls, F.create_map(*[x for r, c in table.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])[(F.col("guard") % modulo).cast("int")])

    return rows.select(
        (F.col("fam") * F.lit(STEP) + F.col("k")).alias("edge_seq"), "src", "dst", "type", by(GUARDS, 8).alias("guarded_by"), by(FILTERS, 8).alias("filtered_by"), (F.col("type") == "References").alias("signature")
    )


_LAYER_NODES = """
SELECT concat('proj:', r_name) AS node_id, r_regionkey AS k, 0 AS fam, 'Project' AS type, CAST(NULL AS STRING) AS foreign_type, r_name AS name, r_name AS project, CAST(NULL AS STRING) AS declaring_type,
  false AS is_test, false AS is_test_lifecycle, false AS is_abstract, CAST(NULL AS STRING) AS entry_point_kind, CAST(NULL AS BIGINT) AS thrown, CAST(NULL AS STRING) AS firm, CAST(NULL AS STRING) AS maybe
FROM region
UNION ALL
SELECT concat('m:o', o_orderkey), o_orderkey, 1, 'Method', NULL, concat('Order', o_orderkey), r_name, concat('type:c', o_custkey), o_orderpriority = '1-URGENT', false, false,
  CASE o_orderpriority WHEN '2-HIGH' THEN 'pageHandler' WHEN '3-MEDIUM' THEN 'eventHandler' WHEN '5-LOW' THEN 'middleware' END, NULL, NULL, NULL
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('hook:c', c_custkey), c_custkey, 2, 'Method', NULL, c_name, r_name, concat('type:c', c_custkey), false, true, false, NULL, NULL, NULL, NULL
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('type:c', c_custkey), c_custkey, 3, 'Class', NULL, c_name, r_name, NULL, false, false, false, NULL, NULL, NULL, NULL
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('m:p', p_partkey), p_partkey, 4, 'Method', NULL, p_name, r_name, concat('type:', p_brand), false, false, true, NULL, NULL, NULL, NULL
FROM part JOIN region ON p_partkey % 5 = r_regionkey
UNION ALL
SELECT concat('m:s', s_suppkey), s_suppkey, 5, 'Method', NULL, s_name, r_name, NULL, false, false, false, NULL, CASE WHEN s_acctbal < 5000 THEN s_suppkey % 3 END, NULL, NULL
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('m:n', n_nationkey), n_nationkey, 6, 'Method', NULL, n_name, r_name, NULL, false, false, false, CASE WHEN n_regionkey = 4 THEN 'pageHandler' END, NULL,
  CASE n_regionkey WHEN 0 THEN 'SystemException' WHEN 1 THEN 'CustomException' WHEN 4 THEN '*' END, CASE n_regionkey WHEN 2 THEN 'Exception' WHEN 3 THEN '*' WHEN 1 THEN 'Exception' END
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('m:r', r_regionkey), r_regionkey, 7, 'Method', NULL, r_name, r_name, NULL, false, false, false, NULL, NULL, NULL, NULL FROM region
UNION ALL
SELECT concat('mod:', p_brand), min(p_partkey), 8, 'Unknown', CASE WHEN min(p_partkey) % 2 = 0 THEN 'luaModule' ELSE 'LuaModule' END, p_brand, NULL, NULL, false, false, false, NULL, NULL, NULL, NULL FROM part GROUP BY p_brand
"""

_LAYER_EDGES = """
SELECT 1 AS fam, l_orderkey * 1000000 + l_partkey AS k, concat('m:o', l_orderkey) AS src, concat('m:p', l_partkey) AS dst, 'Calls' AS type, min(l_linenumber) AS guard FROM lineitem GROUP BY l_orderkey, l_partkey
UNION ALL
SELECT 2, l_suppkey * 1000000 + l_partkey, concat('m:s', l_suppkey), concat('m:p', l_partkey), 'Implements', 0 FROM lineitem GROUP BY l_suppkey, l_partkey
UNION ALL
SELECT 3, s_suppkey, concat('m:s', s_suppkey), concat('m:n', s_nationkey), 'Calls', 3 FROM supplier
UNION ALL
SELECT 4, n_nationkey, concat('m:n', n_nationkey), concat('m:r', n_regionkey), 'Calls', 3 FROM nation
UNION ALL
SELECT 5, c_custkey, concat('hook:c', c_custkey), concat('m:n', c_nationkey), 'Calls', 3 FROM customer
UNION ALL
SELECT 6, o_orderkey, concat('type:c', o_custkey), concat('m:o', o_orderkey), 'Contains', 0 FROM orders
UNION ALL
SELECT 7, o_orderkey, concat('m:o', o_orderkey), concat('ext:', o_orderpriority), 'DecoratedBy', 0 FROM orders
UNION ALL
SELECT 8, a.r_regionkey, concat('proj:', a.r_name), concat('proj:', b.r_name), 'DependsOn', 0 FROM region a JOIN region b ON a.r_regionkey + 1 = b.r_regionkey
UNION ALL
SELECT 9, r_regionkey, concat('m:r', r_regionkey), concat('ghost:', r_regionkey), 'Calls', 3 FROM region
"""

LAYER_CTES = f"nodes AS ({_LAYER_NODES.replace('AS STRING', 'AS VARCHAR')}), edges AS ({_LAYER_EDGES})"


def _chain(number: Column) -> Column:
    own = F.create_map(*[x for r, c in CHAINS.items() for x in (F.lit(r), F.array(*map(F.lit, c)))])[number.cast("int")]
    return F.when(number.isNotNull(), F.array(F.struct(own[0].alias("type"), own.alias("chain"), F.lit(False).alias("conditional"))))


def layered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(f"WITH {_views(spark, sf_dir)} {_LAYER_NODES}")
    bound = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.concat(F.lit("m:s"), "l_suppkey").alias("node_id")).agg(F.collect_set(F.concat(F.lit("m:p"), "l_partkey")).alias("implements_methods"))
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    rows = rows.join(bound, "node_id", "left").withColumns({"throws": _chain(F.col("thrown")), "boundary_catches": one("firm"), "boundary_catches_filtered": one("maybe")})
    return rows.withColumn("node_seq", F.col("fam") * F.lit(STEP) + F.col("k")).drop("fam", "k", "thrown", "firm", "maybe")


def layered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _guarded(spark.sql(f"WITH {_views(spark, sf_dir)} {_LAYER_EDGES}"))


_WRITTEN: dict[tuple[str, str, str], tuple[list, Graph]] = {}


def _kept(spark: SparkSession, sf_dir: str, name: str, nodes, edges) -> Graph:
    """The graph as tables in the shared folder, written once for each session and state of the input."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stamp = []
    for t in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        at = path.getFileSystem(conf).getFileStatus(path)
        stamp.append((at.getLen(), at.getModificationTime()))
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN or _WRITTEN[key][0] != stamp:
        path = fresh_path(spark, f"graph-{name}")
        write_tables(Graph.of(nodes(spark, sf_dir), edges(spark, sf_dir)), path)
        _WRITTEN[key] = stamp, read_tables(spark, path)
    return _WRITTEN[key][1]


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    return _kept(spark, sf_dir, "shop", nodes, edges)


def layered_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return _kept(spark, sf_dir, "layers", layered_nodes, layered_edges)
