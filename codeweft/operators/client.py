"""Pages and the scripts they load: names that couple markup, scripts and controllers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scan
from ..functions.paths import resolve_views
from ..store import settled
from .traverse import bfs


def page_facts(pages: DataFrame) -> DataFrame:
    """``pages``: id, path, text. What the scanners find on each page."""
    rows = pages.withColumn("text", scan.strip_page_comments("text"))
    t = F.col("text")
    return rows.select(
        "id", "path", scan.is_page(t).alias("is_page"), scan.route_template(t).alias("route"), scan.model_directive(t).alias("model_type"), scan.layout(t).alias("layout"), scan.sections(t).alias("sections"),
        scan.inject_directives(t).alias("injects"), scan.view_data_keys(t).alias("view_data_keys"), scan.asset_references(t).alias("assets"), scan.inline_scripts(t).alias("inline"), scan.rendered_data_keys(t).alias("data_keys"),
        scan.bound_data_keys(t).alias("bound_keys"), scan.rendered_ids(t).alias("ids"), scan.dynamic_ids(t).alias("dynamic_ids"), scan.partial_renders("text").alias("partials"), scan.tag_helpers("text").alias("tag_helpers"),
    )


def script_facts(scripts: DataFrame) -> DataFrame:
    """``scripts``: id, path, text."""
    t = F.col("text")
    return scripts.select(
        "id", "path", (F.regexp_count("text", F.lit("\n")) + 1).alias("line_count"), scan.data_keys(t).alias("data_keys"), scan.data_keys_written(t).alias("data_keys_written"), scan.read_only_keys(t).alias("read_only_keys"),
        scan.foreign_ids(t).alias("selector_ids"), scan.dynamic_selectors(t).alias("dynamic_selectors"), scan.api_calls(t).alias("api_calls"),
    )


def page_nodes(facts: DataFrame) -> DataFrame:
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return facts.select(F.col("id").alias("node_id"), F.when(F.col("is_page"), "RazorPage").otherwise("PartialView").alias("type"), name.alias("name"), F.col("path").alias("file_path"), "model_type", F.to_json(F.struct(F.size("inline").alias("inlineScriptCount"), F.col("route").alias("routeTemplate"), "layout", F.col("view_data_keys").alias("viewDataKeys"), "sections")).alias("props"))


def tag_helpers(facts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the tags that bind a property (asp-for), one a page and line, and edges: RendersComponent from the page, BindsTo
    to the first node that has the page's model as its name or full name."""
    rows = facts.select("id", "path", "model_type", F.posexplode("tag_helpers").alias("k", "t")).where(F.map_contains_key("t.attributes", "asp-for"))
    name = F.regexp_replace(F.element_at("t.attributes", "asp-for"), r"^[\x22\x27]+|[\x22\x27]+$", "")
    rows = rows.select("id", "path", "model_type", "k", F.concat_ws(":", F.lit("th"), "id", F.col("t.line").cast("string")).alias("node_id"), name.alias("property"), F.col("t.tag").alias("tag"), F.col("t.line").alias("line"))
    last = rows.groupBy("node_id").agg(F.max_by(F.struct("id", "path", "model_type", "property", "tag", "line"), "k").alias("r")).select("node_id", "r.*")
    shown = last.select(
        "node_id", F.lit("TagHelperInvocation").alias("type"), F.concat("tag", F.lit(' asp-for="'), "property", F.lit('"')).alias("name"), F.col("path").alias("file_path"), F.col("line").alias("line_start"),
        F.to_json(F.struct("property", F.col("tag").alias("tagName"))).alias("props"),
    )
    keys = nodes.select("node_id", "node_seq", F.explode(F.array_distinct(F.array_compact(F.array("name", "full_name")))).alias("model_type"))
    models = keys.groupBy("model_type").agg(F.min_by("node_id", F.struct("node_seq", "node_id")).alias("target"))
    edge = lambda df, a, b, t: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(t).alias("type"))
    return shown, edge(rows, "id", "node_id", "RendersComponent").unionByName(edge(rows.join(models, "model_type"), "node_id", "target", "BindsTo"))


def inline_scripts(facts: DataFrame) -> DataFrame:
    """id (page#inline-n), path, text, page of scripts inside pages."""
    rows = facts.select(F.col("id").alias("page"), "path", F.posexplode("inline").alias("k", "text"))
    return rows.select(F.concat(F.regexp_replace("page", "^page:", "js:"), F.lit("#inline-"), (F.col("k") + 1).cast("string")).alias("id"), "path", "text", "page")


def asset_nodes(assets: DataFrame) -> DataFrame:
    """``assets``: id, path, text, vendor_reason."""
    kind = F.when(F.endswith(F.lower("path"), F.lit(".css")), "CssFile").otherwise("JavaScriptFile")
    props = F.to_json(F.struct(F.col("path").alias("relativePath"), (F.regexp_count("text", F.lit("\n")) + 1).alias("lineCount"), F.contains("id", F.lit("#inline-")).alias("inline"), F.col("vendor_reason").isNotNull().alias("vendor"), F.col("vendor_reason").alias("vendorReason")))
    return assets.select(F.col("id").alias("node_id"), kind.alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file_path"), props.alias("props"))


def loaded_scripts(facts: DataFrame, assets: DataFrame) -> DataFrame:
    """page, script of each asset that a page refers to by a local path. ``assets``: id, path (under the web root)."""
    refs = facts.select(F.col("id").alias("page"), F.explode("assets").alias("href")).withColumn("k", F.lower(scan.asset_path(F.col("href"))))
    return refs.join(assets.select(F.col("id").alias("script"), F.lower("path").alias("k")), "k").select("page", "script").distinct()


def partial_edges(facts: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """RendersPartial edges to the best template, and stub nodes for names that none serves. ``templates``: id, path."""
    wanted = facts.select("id", F.col("path").alias("source"), F.explode("partials").alias("p")).select("id", "source", "p.name", "p.line", "p.is_tag", F.lit(None).cast("string").alias("controller"))
    best = resolve_views(wanted, templates, ["id", "name"]).where("rank = 0").join(templates.select(F.col("id").alias("target"), F.replace("path", F.lit("\\"), F.lit("/")).alias("path")), "path")
    rows = wanted.join(best.select("id", "name", "target"), ["id", "name"], "left").withColumn("dst", F.coalesce("target", F.concat(F.lit("partial:"), "name")))
    edges = rows.select(F.col("id").alias("src"), "dst", F.lit("RendersPartial").alias("type"), "line", F.to_json(F.struct(F.col("is_tag").alias("isTagHelper"))).alias("props"))
    stubs = rows.where("target is null").select(F.col("dst").alias("node_id"), F.lit("PartialView").alias("type"), "name").distinct()
    return edges, stubs


def composed_scopes(facts: DataFrame, includes: DataFrame) -> DataFrame:
    """page, data_keys, bound_keys, ids, dynamic_ids of what a page shows with its layout and partials. ``includes``: src, dst (pages)."""
    steps = settled(includes.select("src", "dst", F.lit(0).cast("long").alias("edge_seq")).distinct(), "includes")
    reach = bfs(facts.select(F.col("id").alias("page"), F.col("id").alias("node")), steps, None, keys=("page",))
    rows = reach.select("page", "node").join(facts.select(F.col("id").alias("node"), *NAMES, "dynamic_ids"), "node")
    return settled(_unions(rows, "page", NAMES).join(rows.groupBy("page").agg(F.sum("dynamic_ids").alias("dynamic_ids")), "page"), "scopes")


NAMES = ("data_keys", "bound_keys", "ids")


def _unions(rows: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """The sorted union of each array column by ``key``. Names are made distinct before they are gathered, so a list holds no
    more than the different names, however many rows a key has."""

    def tagged(c: str) -> Column:
        return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(c).alias("of"), x.alias("name")))

    every = rows.select(key, F.explode_outer(F.concat(*map(tagged, names))).alias("t")).select(key, "t.of", "t.name").distinct()
    return every.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("of") == c, F.col("name")))).alias(c) for c in names])


def coupling_edges(scopes: DataFrame, loads: DataFrame, scripts: DataFrame) -> DataFrame:
    """ViewDataReadBy where a script touches keys that the page's server side computes, DomSelectedBy where it selects its ids."""
    rows = loads.join(scopes, "page").join(scripts.select(F.col("id").alias("script"), F.col("data_keys").alias("keys"), "selector_ids"), "script")
    low = lambda c: F.transform(c, F.lower)
    shared = rows.select("page", "script", F.array_intersect(low("bound_keys"), low("keys")).alias("keys"), F.array_intersect("ids", "selector_ids").alias("ids"))
    edge = lambda c, t, n: shared.where(F.size(c) > 0).select(F.col("page").alias("src"), F.col("script").alias("dst"), F.lit(t).alias("type"), F.to_json(F.struct(F.array_sort(c).alias(n))).alias("props"))
    return edge("keys", "ViewDataReadBy", "dataKeys").unionByName(edge("ids", "DomSelectedBy", "ids"))


def rendered_for(scopes: DataFrame, loads: DataFrame) -> DataFrame:
    """script, data_keys, ids, dynamic of all pages that load it."""
    rows = loads.join(scopes, "page")
    return _unions(rows, "script", ("data_keys", "ids")).join(rows.groupBy("script").agg(F.bool_or(F.col("dynamic_ids") > 0).alias("dynamic")), "script")


def unbound_names(scopes: DataFrame, loads: DataFrame, scripts: DataFrame) -> DataFrame:
    """script, keys, ids that no page renders; nothing for scripts that no page loads, no ids where any are computed."""
    rows = scripts.withColumnRenamed("id", "script").select("script", "read_only_keys", "selector_ids", "dynamic_selectors").join(rendered_for(scopes, loads), "script")
    keys = F.array_sort(F.array_except(F.transform("read_only_keys", F.lower), F.transform("data_keys", F.lower)))
    sure = (F.col("dynamic_selectors") == 0) & ~F.col("dynamic")
    ids = F.when(sure, F.array_sort(F.array_except("selector_ids", "ids"))).otherwise(F.array().cast("array<string>"))
    return rows.select("script", keys.alias("keys"), ids.alias("ids")).where("size(keys) > 0 or size(ids) > 0")


def api_edges(scripts: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls from a script to the controller that its /api/X/ URL names."""
    calls = scripts.select(F.col("id").alias("src"), F.explode("api_calls").alias("url")).withColumn("segment", scan.api_segment(F.col("url"))).where("segment is not null")
    calls = calls.withColumn("key", F.explode(F.array(F.lower("segment"), F.lower(F.concat("segment", F.lit("Controller"))))))
    first = nodes.where("type = 'ApiController'").groupBy(F.lower("name").alias("key")).agg(F.min(F.struct("node_seq", "node_id")).alias("n"))
    rows = calls.join(first, "key").groupBy("src", "url").agg(F.min("n").alias("n"))
    return rows.select("src", F.col("n.node_id").alias("dst"), F.lit("Calls").alias("type"), F.to_json(F.struct("url")).alias("props"))
