"""Views by name, and shapes by the template names that could serve them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import normalised, resolve_views, shape_candidates


def visible_projects(projects: DataFrame, references: DataFrame) -> DataFrame:
    """project, sees: itself and what it refers to directly. ``projects``: name; ``references``: src, dst."""
    return projects.select(F.col("name").alias("project"), F.col("name").alias("sees")).unionByName(references.select(F.col("src").alias("project"), F.col("dst").alias("sees"))).distinct()


def view_edges(calls: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``calls``: method, call, name (null if computed), controller, line; ``templates``: id, path.

    ReturnsView edges, and findings: method, missing (names without a template), unresolved (number of computed ones).
    """
    fixed = calls.where("name is not null").withColumn("source", F.lit(None).cast("string"))
    best = resolve_views(fixed, templates, ["method", "call"]).where("rank = 0").join(templates.select(F.col("id").alias("dst"), normalised(F.col("path")).alias("path")), "path")
    rows = fixed.join(best.select("method", "call", "dst"), ["method", "call"], "left")
    edges = rows.where("dst is not null").select(F.col("method").alias("src"), "dst", F.lit("ReturnsView").alias("type"), "line", F.to_json(F.struct(F.col("name").alias("viewName"))).alias("props"))
    missing = rows.where("dst is null").select("method", F.col("name").alias("m"), F.lit(0).alias("u")).unionByName(calls.where("name is null").select("method", F.lit(None).cast("string").alias("m"), F.lit(1).alias("u")))
    found = missing.groupBy("method").agg(F.array_sort(F.collect_set("m")).alias("missing"), F.sum("u").alias("unresolved"))
    return edges, found


def helper_renders(edges: DataFrame, calls: DataFrame, actions: DataFrame) -> DataFrame:
    """Views that a method which isn't an action returns, for the actions that call it (one hop). ``actions``: method."""
    helpers = edges.join(actions.select(F.col("method").alias("src")), "src", "left_anti")
    callers = calls.where("type = 'Calls'").select(F.col("src").alias("action"), F.col("dst").alias("src")).join(actions.select(F.col("method").alias("action")), "action", "left_semi")
    return helpers.join(callers, "src").select(F.col("action").alias("src"), "dst", F.lit("ReturnsView").alias("type"), "line", F.to_json(F.struct(F.col("src").alias("via"))).alias("props"))


def shape_nodes(mentions: DataFrame) -> DataFrame:
    """``mentions``: name, by, is_alternate, in_test. One node a name; required_by: who needs it for sure."""
    sure = ~F.coalesce("is_alternate", F.lit(False)) & ~F.coalesce("in_test", F.lit(False))
    rows = mentions.groupBy("name").agg(F.array_sort(F.collect_set(F.when(sure, F.col("by")))).alias("required_by"))
    return rows.select(F.concat(F.lit("shape:"), "name").alias("node_id"), F.lit("NamedBinding").alias("type"), "name", "required_by")


def produce_edges(mentions: DataFrame) -> DataFrame:
    props = F.to_json(F.struct(F.coalesce("is_alternate", F.lit(False)).alias("isAlternate"), F.coalesce("in_test", F.lit(False)).alias("inTestCode")))
    return mentions.select(F.col("by").alias("src"), F.concat(F.lit("shape:"), "name").alias("dst"), F.lit("Produces").alias("type"), "line", props.alias("props")).distinct()


def placement_mentions(rules: DataFrame) -> DataFrame:
    """What placement rules mention: alternates are optional, wrappers and renamed shapes are needed."""
    by = F.concat(F.lit("placement:"), "path")
    part = lambda names, optional: rules.select(F.explode(names).alias("name"), by.alias("by"), F.lit(optional).alias("is_alternate"), F.lit(False).alias("in_test"), "line")
    return part(F.col("alternates"), True).unionByName(part(F.array_compact(F.concat("wrappers", F.array("renamed_to"))), False))


def placement_nodes(rules: DataFrame) -> DataFrame:
    return rules.select(F.concat(F.lit("placement:"), "path").alias("node_id"), F.lit("ConfigurationFile").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file_path")).distinct()


def placement_edges(rules: DataFrame) -> DataFrame:
    props = F.to_json(F.struct("place", F.col("display_type").alias("displayType"), "differentiator", "filters", "hides"))
    return rules.select(F.concat(F.lit("placement:"), "path").alias("src"), F.concat(F.lit("shape:"), "shape").alias("dst"), F.lit("References").alias("type"), "line", props.alias("props"))


def shape_bindings(shapes: DataFrame, templates: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """``shapes``: name, projects (that mention it); ``templates``: id, path, project. All templates that can serve: name, template, rank, matched_as."""
    tries = shapes.select("name", "projects", F.posexplode(shape_candidates(F.col("name"))).alias("pos", "matched_as")).withColumn("k", F.lower("matched_as"))
    stems = templates.select(F.col("id").alias("template"), "project", F.lower(F.regexp_replace(F.element_at(F.split(normalised(F.col("path")), "/"), -1), r"\.[^.]+$", "")).alias("k"))
    rows = tries.join(stems, "k")
    if visible is not None:
        seen = rows.select("name", "template", "project", F.explode_outer("projects").alias("from")).join(visible.select(F.col("project").alias("from"), F.col("sees").alias("project")), ["from", "project"], "left_semi")
        rows = rows.join(seen.select("name", "template").distinct(), ["name", "template"], "left_semi")
    best = rows.groupBy("name", "template").agg(F.min(F.struct("pos", "matched_as")).alias("b"))
    order = Window.partitionBy("name").orderBy("b.pos", "template")
    return best.select("name", "template", F.col("b.matched_as").alias("matched_as"), (F.row_number().over(order) - 1).alias("rank"))


def bound_edges(bindings: DataFrame, templates: DataFrame) -> DataFrame:
    """BoundBy edges from a shape to every template that can serve it, with rank, kind of template and the name that matched."""
    kind = F.when(F.endswith(F.lower("path"), F.lit(".liquid")), "liquid").otherwise("razor")
    rows = bindings.join(templates.select(F.col("id").alias("template"), "path"), "template")
    return rows.select(F.concat(F.lit("shape:"), "name").alias("src"), F.col("template").alias("dst"), F.lit("BoundBy").alias("type"), F.to_json(F.struct("rank", kind.alias("bindingKind"), F.col("matched_as").alias("matchedAs"))).alias("props"))


def shape_verdicts(shapes: DataFrame, bindings: DataFrame, rules: DataFrame) -> DataFrame:
    """name, verdict: bound, renderSuppressed (an unconditional rule hides it), noRequiredProducer or unbound (a finding)."""
    hidden = rules.groupBy(F.col("shape").alias("name")).agg(F.bool_or(F.col("hides") & F.col("unconditional")).alias("hidden"))
    rows = shapes.join(bindings.where("rank = 0").select("name", F.lit(True).alias("is_bound")), "name", "left").join(hidden, "name", "left")
    verdict = F.when(F.col("is_bound"), "bound").when(F.coalesce("hidden", F.lit(False)), "renderSuppressed").when(F.size("required_by") == 0, "noRequiredProducer").otherwise("unbound")
    return rows.select("name", verdict.alias("verdict"), "required_by")


def findings(verdicts: DataFrame, views: DataFrame) -> DataFrame:
    """kind, subject, detail of all that a build should report."""
    shapes = verdicts.where("verdict = 'unbound'").select(F.lit("unboundShape").alias("kind"), F.col("name").alias("subject"), F.array_join("required_by", ", ").alias("detail"))
    missing = views.where(F.size("missing") > 0).select(F.lit("missingViews").alias("kind"), F.col("method").alias("subject"), F.array_join("missing", ", ").alias("detail"))
    unclear = views.where("unresolved > 0").select(F.lit("unresolvedViews").alias("kind"), F.col("method").alias("subject"), F.col("unresolved").cast("string").alias("detail"))
    return shapes.unionByName(missing).unionByName(unclear)
