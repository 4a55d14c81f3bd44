"""Fact tables for the registered queries, made of the supplied tables, and the same facts as SQL.

Page, script and configuration texts are put together from the columns of a row, so what a scanner
must find in them is known by the row itself: the SQL twins never scan a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")

#: A page a customer.
PAGES = r"""
SELECT concat('page:', c_custkey) AS id, concat('Pages/', c_nationkey, '/P', c_custkey, '.cshtml') AS path,
  concat('@page "/c/', c_custkey, '"', chr(10), '@model Shop.M', c_nationkey, chr(10), '@* <partial name="_Gone" />', chr(10), '*@', chr(10), '@inject IStore', c_nationkey, ' Store', chr(10), '@section Scripts { }', chr(10),
    '@{ Layout = "_L', c_custkey % 2, '"; var x = ViewData["T', c_custkey % 5, '"]; }', chr(10),
    '<script src="~/js/s', c_custkey % 97, '.js?v=1"></script><link rel=stylesheet href="/css/', c_custkey % 4, '.css">', chr(10),
    '<div id="d', c_custkey % 13, '" data-key', c_custkey % 6, '="@Model.X" data-fixed="1"><i id="row-@i"></i></div><input asp-for="P.Q[', c_custkey % 3, ']">', chr(10),
    '<partial name="_Part', c_custkey % 9, '" />@await Html.PartialAsync("_Other")', chr(10), '<script>let a = ', c_custkey, ';</script>') AS text
FROM customer
UNION ALL
SELECT concat('page:_Part', n_nationkey), concat('Pages/Shared/_Part', n_nationkey, '.cshtml'), concat('<b id="part', n_nationkey, '" data-inner', n_nationkey, '="@x"></b>') FROM nation
"""

#: A script a part; those of numbers below 97 are loaded by pages.
SCRIPTS = r"""
SELECT concat('js:s', p_partkey) AS id, concat('js/s', p_partkey, '.js') AS path,
  concat('/* el.dataset.gone */', chr(10), '// getElementById("gone")', chr(10), 'a = el.dataset.key', p_partkey % 6, '; b = el.dataset.camelCase', p_partkey % 4, '; el.dataset.own', p_partkey % 3, ' = 1;', chr(10),
    'document.getElementById("d', p_partkey % 13, '"); document.querySelector("#lost', p_partkey % 5, '");', CASE WHEN p_size < 10 THEN ' document.getElementById(name);' ELSE '' END, ' fetch("/api/', p_brand, '/1?x=2");') AS text
FROM part
"""


def facts(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...] = TABLES) -> DataFrame:
    """The rows of ``sql`` over the supplied tables, which are named inline: no view of the session is touched."""
    views = ", ".join(f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in tables)
    return spark.sql(f"WITH {views} {sql}")


def texts(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """As ``facts``, with the tables' rows spread over all tasks: few bytes of a table make many texts."""
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    views = ", ".join(f"{t} AS (SELECT /*+ REPARTITION({n}) */ * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES)
    return spark.sql(f"WITH {views} {sql}")
