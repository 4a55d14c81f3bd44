"""Fact tables of declared symbols into nodes and structural edges.

Facts: ``symbols`` (id, seq, type, name, full_name, project, file_path, line_start, line_end, is_public,
is_interface, base_type, generated_from), ``methods``, ``members``, ``parameters``, ``attributes`` and
others named where they're used. Of what is declared in parts the first declaration counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import TYPE_KINDS, ci, first_by, flag
from ..store import counted, fresh_path

#: Rows of one name beyond which it is joined by broadcast.
HOT_ROWS = 100_000
#: Names of attribute classes, with or without their suffix; ``suppress_arguments_for`` has full names.
DEFAULT_POLICY: dict[str, Any] = {
    "test_attributes": ["Fact", "Theory", "Test", "TestCase", "TestCaseSource", "TestMethod", "DataTestMethod"],
    "lifecycle_attributes": ["SetUp", "TearDown", "OneTimeSetUp", "OneTimeTearDown", "TestInitialize", "TestCleanup", "ClassInitialize", "ClassCleanup"],
    "controller_attributes": ["ApiController"],
    "bind_property_attributes": ["BindProperty"],
    "suppress_arguments_for": [],
    "registering": [],
}
HANDLER_PREFIXES = tuple(f"On{v}" for v in "Get Post Put Delete Head Options Patch".split())


def _no_names() -> Column:
    return F.array().cast("array<string>")


def merged_policy(override: Mapping[str, Any] | None) -> dict[str, Any]:
    """Sections that the override names replace the default's whole; others stay."""
    return DEFAULT_POLICY | {k: v for k, v in (override or {}).items() if v is not None}


def carries(attributes: Column, names: Sequence[str]) -> Column:
    """Does one of the attributes have one of these names, the suffix aside?"""
    bare = lambda x: x.removesuffix("Attribute")
    own = F.transform(F.coalesce(attributes, _no_names()), lambda a: F.regexp_replace(a, "Attribute$", ""))
    return F.arrays_overlap(own, F.array(*[F.lit(bare(n)) for n in names])) if names else F.lit(False)


# Classifiers


def type_kind(name: Column, base: Column, is_interface: Column, attributes: Column, interfaces: Column | None = None, policy: Mapping[str, Any] = DEFAULT_POLICY) -> Column:
    """Kind of a type by its base, attributes, name and interfaces (display names of all of them); the first rule that fits."""
    base = F.coalesce(base, F.lit(""))
    service = F.endswith(name, F.lit("Service"))
    if interfaces is not None:
        service = service | F.exists(F.coalesce(interfaces, _no_names()), lambda i: F.endswith(i, F.lit("Service")))
    return (
        F.when(F.contains(base, F.lit("PageModel")), "PageModel")
        .when(F.contains(base, F.lit("Controller")) | carries(attributes, policy["controller_attributes"]), "ApiController")
        .when(service, F.when(is_interface, "ServiceInterface").otherwise("ServiceImplementation"))
        .when(F.rlike(name, F.lit("(?:VM|ViewModel|Model)$")), "ViewModel")
        .otherwise("Class")
    )


def entry_kind(policy: Mapping[str, Any] = DEFAULT_POLICY) -> Column:
    """The first entry-point rule that a method fact row meets; columns of booleans and names. Tests have none."""
    own = ~flag("is_static")
    first = F.coalesce(F.get(F.coalesce("parameter_types", _no_names()), F.lit(0)), F.lit(""))
    middleware = flag("is_middleware_type") | F.endswith(F.coalesce(F.regexp_extract("declaring_type", r"([^.:+]+)$", 1), F.lit("")), F.lit("Middleware"))
    handler = F.rlike("name", F.lit(f"^(?:{'|'.join(HANDLER_PREFIXES)})"))
    rules = (
        F.when(F.col("name").isin("Main", "<Main>$") & flag("is_static"), "main")
        .when((F.col("owner_kind") == "PageModel") & handler & flag("is_public") & own, "pageHandler")
        .when((F.col("owner_kind") == "ApiController") & flag("is_public") & own, "controllerAction")
        .when(flag("is_event_handler"), "eventHandler")
        .when(flag("is_async") & (F.col("return_type") == "void"), "asyncVoid")
        .when(flag("is_override") & flag("overrides_outside"), "frameworkOverride")
        .when(F.col("name").isin("Invoke", "InvokeAsync") & own & F.rlike(first, F.lit(r"(?:^|\.)HttpContext$")) & middleware, "middleware")
        .when(flag("implements_outside") & own, "frameworkInterface")
    )
    return F.when(~is_test(F.col("attributes"), policy), rules)


HTTP_VERBS = ("Get", "Post", "Put", "Delete", "Patch")


def http_verb(attributes: Column) -> Column:
    """The verb that a method's attributes name, the first of the list above; null without one."""
    verb = F.lit(None).cast("string")
    for v in reversed(HTTP_VERBS):
        verb = F.when(carries(attributes, [f"Http{v}"]), v.upper()).otherwise(verb)
    return verb


def http_route(usages: Column) -> Column:
    """``usages``: an array of (name, argument). The argument of the first attribute that gives a route."""
    routed = F.filter(usages, lambda u: F.regexp_replace(u["name"], "Attribute$", "").isin("Route", "HttpGet", "HttpPost"))
    return F.get(routed, F.lit(0))["argument"]


def is_test(attributes: Column, policy: Mapping[str, Any] = DEFAULT_POLICY) -> Column:
    return carries(attributes, policy["test_attributes"])


def with_roles(methods: DataFrame, policy: Mapping[str, Any] = DEFAULT_POLICY) -> DataFrame:
    """is_test and is_test_lifecycle of methods (declaring_type, attributes); hooks count only in types with tests."""
    rows = methods.withColumn("is_test", is_test(F.col("attributes"), policy))
    tested = rows.where("is_test").select("declaring_type").distinct().withColumn("__tested", F.lit(True))
    hook = carries(F.col("attributes"), policy["lifecycle_attributes"]) | flag("is_ctor") | flag("is_fixture_hook")
    return rows.join(tested, "declaring_type", "left").withColumn("is_test_lifecycle", hook & ~F.col("is_test") & F.coalesce("__tested", F.lit(False))).drop("__tested")


def effectively_public(chain: Column) -> Column:
    """Public if all containers are: an array of flags, the symbol's own among them."""
    return F.forall(chain, lambda x: F.coalesce(x, F.lit(False)))


def is_generated(path: Column) -> Column:
    return F.coalesce(F.endswith(F.lower(path), F.lit(".g.cs")), F.lit(False))


# Nodes


def type_nodes(symbols: DataFrame) -> DataFrame:
    rows = first_by(symbols, ["id"], "seq")
    return rows.withColumnsRenamed({"id": "node_id", "seq": "node_seq"})


def member_nodes(facts: DataFrame, kind_col: str = "type") -> tuple[DataFrame, DataFrame]:
    """Nodes of methods, properties, fields or parameters (id, seq, owner, ...) and the Contains edges to them."""
    rows = first_by(facts, ["id"], "seq")
    nodes = rows.withColumnsRenamed({"id": "node_id", "seq": "node_seq"} | ({kind_col: "type"} if kind_col != "type" else {})).withColumn("declaring_type", F.col("owner"))
    return nodes.drop("owner"), rows.select(F.col("owner").alias("src"), F.col("id").alias("dst"), F.lit("Contains").alias("type"))


def decorated_parameters(parameters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``parameters``: method, seq, name, attributes; only those with an attribute become nodes."""
    rows = parameters.where(F.size(F.coalesce("attributes", F.array().cast("array<string>"))) > 0)
    rows = rows.withColumn("id", F.concat(F.regexp_replace("method", "^m:", "param:"), F.lit("#"), "name")).withColumn("owner", F.col("method")).withColumn("type", F.lit("Parameter"))
    return member_nodes(rows)


def project_nodes(projects: DataFrame, nodes: DataFrame) -> DataFrame:
    """``projects``: name. Nodes with the number of nodes that each project has."""
    counts = nodes.where("project is not null").groupBy(ci("project").alias("k")).agg(F.count("*").alias("n"))
    rows = projects.withColumn("k", ci("name")).join(counts, "k", "left")
    return rows.select(F.concat(F.lit("proj:"), "name").alias("node_id"), F.lit("Project").alias("type"), "name", F.col("name").alias("project"), F.to_json(F.struct(F.coalesce("n", F.lit(0)).alias("nodeCount"))).alias("props"))


def project_references(references: DataFrame, projects: DataFrame) -> DataFrame:
    """``references``: project, uses. DependsOn edges whose ends both exist."""
    known = projects.select("name")
    rows = references.join(known.withColumnRenamed("name", "project"), "project", "left_semi").join(known.withColumnRenamed("name", "uses"), "uses", "left_semi")
    return rows.select(F.concat(F.lit("proj:"), "project").alias("src"), F.concat(F.lit("proj:"), "uses").alias("dst"), F.lit("DependsOn").alias("type")).distinct()


def without_tests(projects: DataFrame) -> DataFrame:
    return projects.where(~flag("is_test_project"))


# Edges


def type_index(nodes: DataFrame, kinds: Sequence[str] = TYPE_KINDS) -> DataFrame:
    """full_name, target: the first type of each full name."""
    rows = nodes.where(F.col("type").isin(*kinds) & F.col("full_name").isNotNull())
    return rows.groupBy("full_name").agg(F.min_by("node_id", F.struct("node_seq", "node_id")).alias("target"))


def by_name(rows: DataFrame, index: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``index`` (a row a name). Names of more than ``HOT_ROWS`` rows, of which there can be but few, are
    looked up by broadcast, so that no task gathers the rows of one: those that all use are often types outside, without any match."""
    spark = rows.sparkSession
    hot, n = counted(rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > HOT_ROWS).select(key), fresh_path(spark, "hot"))
    if not n:
        return rows.join(index, key, how)
    hot = F.broadcast(hot)
    rest, many = rows.join(hot, key, "left_anti"), rows.join(hot, key, "left_semi")
    return rest.join(index, key, how).unionByName(many.join(F.broadcast(index.join(hot, key, "left_semi")), key, how))


def inheritance_edges(symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    index = type_index(nodes, ("PageModel", "Class")).withColumnRenamed("full_name", "base_type")
    return by_name(symbols, index, "base_type").select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit("Inherits").alias("type")).distinct()


def reference_edges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``facts``: id, owner, names (array), signature. References to the types named; a signature's to its own type is dropped."""
    rows = by_name(facts.select("id", "owner", flag("signature").alias("signature"), F.explode("names").alias("full_name")), type_index(nodes), "full_name")
    rows = rows.where(~(F.col("signature") & F.col("target").eqNullSafe(F.col("owner"))) & (F.col("target") != F.col("id")))
    return rows.select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit("References").alias("type"), "signature").distinct()


def extension_edges(methods: DataFrame, nodes: DataFrame) -> DataFrame:
    """``methods``: id, extends (full name)."""
    index = type_index(nodes).withColumnRenamed("full_name", "extends")
    return by_name(methods, index, "extends").select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit("Extends").alias("type")).distinct()


def implements_edges(methods: DataFrame, nodes: DataFrame) -> DataFrame:
    """``methods``: id, implements_methods; both ends must be nodes."""
    ids = nodes.select("node_id")
    rows = methods.select(F.col("id").alias("src"), F.explode("implements_methods").alias("dst")).distinct()
    return rows.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi").withColumn("type", F.lit("Implements"))


def attribute_edges(usages: DataFrame, nodes: DataFrame, policy: Mapping[str, Any] = DEFAULT_POLICY) -> tuple[DataFrame, DataFrame]:
    """``usages``: id, attribute (full name), name, assembly, target, line, source, args (JSON). Edges, and nodes for types outside.

    A usage counts once for each (id, attribute, target, line, source, args); arguments of the attributes
    that the policy names (by default none) are left out.
    """
    args = F.when(~F.col("attribute").isin(*policy["suppress_arguments_for"]), F.col("args"))
    rows = usages.withColumn("args", args).dropDuplicates(["id", "attribute", "target", "line", "source", "args"])
    rows = by_name(rows, type_index(nodes).withColumnRenamed("full_name", "attribute").withColumnRenamed("target", "declared"), "attribute", "left")
    to = F.coalesce("declared", F.concat(F.lit("ext:"), "attribute"))
    edges = rows.select(F.col("id").alias("src"), to.alias("dst"), F.lit("DecoratedBy").alias("type"), "line", F.to_json(F.struct("target", "args", "source")).alias("props"))
    outside = rows.where("declared is null").groupBy(to.alias("node_id")).agg(F.min("name").alias("name"), F.min("attribute").alias("full_name"), F.min("assembly").alias("assembly"))
    outside = outside.select("node_id", F.lit("ExternalType").alias("type"), "name", "full_name", F.to_json(F.struct("assembly", F.lit(True).alias("external"))).alias("props"))
    return edges, outside


def register_edges(usages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``usages``: id, attribute, line, registers (full names); types outside are dropped."""
    rows = by_name(usages.select("id", "attribute", "line", F.explode("registers").alias("full_name")), type_index(nodes), "full_name")
    return rows.select(F.col("id").alias("src"), F.col("target").alias("dst"), F.lit("Registers").alias("type"), "line", F.to_json(F.struct("attribute")).alias("props")).distinct()


def injection_edges(facts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``facts``: id, service (name or full name). The declared type, else the implementation whose name lacks the leading I."""
    exact = type_index(nodes).select(F.col("full_name").alias("service"), F.col("target").alias("exact"))
    impl = nodes.where("type = 'ServiceImplementation'").groupBy(F.col("name").alias("bare")).agg(F.min_by("node_id", F.struct("node_seq", "node_id")).alias("impl"))
    bare = F.regexp_replace(F.regexp_extract("service", r"([^.]+)$", 1), r"^I(?=\p{Lu})", "")
    rows = by_name(by_name(facts, exact, "service", "left").withColumn("bare", bare), impl, "bare", "left")
    rows = rows.withColumn("from", F.coalesce("exact", "impl")).where("`from` is not null")
    return rows.select(F.col("from").alias("src"), F.col("id").alias("dst"), F.lit("InjectedInto").alias("type")).distinct()


def compiled_links(pages: DataFrame, symbols: DataFrame) -> DataFrame:
    """``pages``: id, path; ``symbols``: id, generated_from. References from a page to each class compiled from it."""
    key = lambda c: F.lower(F.replace(F.col(c), F.lit("\\"), F.lit("/")))
    a, b = pages.select(F.col("id").alias("src"), key("path").alias("k")), symbols.select(F.col("id").alias("dst"), key("generated_from").alias("k"))
    return a.join(b, "k").select("src", "dst", F.lit("References").alias("type"), F.lit('{"compiledInto":true}').alias("props")).distinct()


def majority_source(parts: DataFrame) -> DataFrame:
    """``parts``: tree, path. The source file that most of a generated tree maps to."""
    counts = parts.groupBy("tree", "path").agg(F.count("*").alias("n"))
    return counts.groupBy("tree").agg(F.max_by("path", F.struct("n", "path")).alias("path"))


def page_links(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pages``: id, model_type, layout, page_model. PageServedBy with its mirror ReturnsView, HasModel (the first view model or class of that name) and UsesLayout."""
    names = nodes.where(F.col("type").isin("PageModel", "ViewModel", "Class")).select("node_id", "node_seq", "type", F.explode(F.array_distinct(F.array_compact(F.array("name", "full_name")))).alias("key"))
    first = names.where("type <> 'PageModel'").groupBy("key").agg(F.min_by("node_id", F.struct("node_seq", "node_id")).alias("target"))
    served = pages.select("id", F.coalesce("page_model", "model_type").alias("key")).join(names.where("type = 'PageModel'").groupBy("key").agg(F.min_by("node_id", F.struct("node_seq", "node_id")).alias("target")), "key")
    model = pages.select("id", F.col("model_type").alias("key")).join(first, "key")
    layouts = nodes.where(F.col("type").isin("PartialView", "RazorPage", "Layout")).groupBy(F.col("name").alias("layout")).agg(F.min_by("node_id", F.struct("node_seq", "node_id")).alias("target"))
    laid = pages.select("id", "layout").join(layouts, "layout")
    edge = lambda df, a, b, t: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("type"))
    return edge(served, "id", "target", "PageServedBy").unionByName(edge(served, "target", "id", "ReturnsView")).unionByName(edge(model, "id", "target", "HasModel")).unionByName(edge(laid, "id", "target", "UsesLayout")).distinct()
