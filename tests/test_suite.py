"""Registered queries against their SQL at the smallest size."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from codeweft.plans import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One of each family; the driver runs them all.
SOME = ["deep_methods", "node_detail", "trace_data_flow", "find_path", "coverage", "call_fold", "quote_edges", "page_links", "property_bag",
    "boundary_escapes", "page_facts", "composed_scopes", "rendered_names", "shape_verdicts", "entry_kinds", "lua_calls", "rule_order", "body_differences", "saved_nodes", "refusals"]


@pytest.fixture(scope="module")
def duck():
    if not Path(DATA).exists():
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_same_as_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr([r[names.index(c)] for c in columns]) for r in found.fetchall())
    assert sorted(repr(list(r)) for r in df.select(*columns).collect()) == want


def test_entry_points():
    queries = __spark_entry__.queries()
    assert set(QUERIES) <= set(queries) and set(__spark_entry__.oracle_sql()) <= set(queries)
