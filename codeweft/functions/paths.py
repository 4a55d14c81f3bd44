"""Paths: third-party classification, template candidates, module names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VENDOR_DIRS = ("lib", "lib_npm", "node_modules", "bower_components", "vendor")
BUILD_DIRS = ("bin", "obj")
SHARED_FOLDERS = ("Shared", "Pages/Shared", "Views/Shared")


def normalised(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def is_build_output(path: Column) -> Column:
    return F.exists(F.split(normalised(path), "/"), lambda s: F.lower(s).isin(*BUILD_DIRS))


def vendor_reason(path: Column, drop_roots: Sequence[str] = (), manifest_dirs: Sequence[str] = ()) -> Column:
    """Why a path under the web root is third-party code, the first reason; null if it's the project's own."""
    parts = F.split(normalised(path), "/")
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    bad = F.get(F.filter(dirs, lambda d: F.lower(d).isin(*VENDOR_DIRS) | F.rlike(d, F.lit("^@."))), F.lit(0))
    reason = F.when(F.startswith(bad, F.lit("@")), F.concat(F.lit("npm scope '"), bad, F.lit("'"))).when(bad.isNotNull(), F.concat(F.lit("vendor directory '"), bad, F.lit("'")))
    head = F.get(dirs, F.lit(0))
    if drop_roots:
        reason = F.coalesce(reason, F.when(F.lower(head).isin(*[d.lower() for d in drop_roots]), F.concat(F.lit("package drop '"), head, F.lit("'"))))
    for d in manifest_dirs:
        reason = F.coalesce(reason, F.when(F.startswith(F.lower(F.concat(F.array_join(dirs, "/"), F.lit("/"))), F.lit(f"{d.lower()}/")), F.lit(f"package manifest in '{d}'")))
    return F.coalesce(reason, F.when(F.contains(F.lower(F.element_at(parts, -1)), F.lit(".min.")), F.lit("minified")))


def drop_roots(directories: DataFrame, dependencies: DataFrame) -> DataFrame:
    """``directories``: root, child; ``dependencies``: name. Roots with two children at least that are named dependencies."""
    names = dependencies.select(F.lower(F.split("name", "/")[0]).alias("key")).distinct()
    hits = directories.withColumn("key", F.lower("child")).join(names, "key", "left_semi")
    return hits.groupBy("root").agg(F.countDistinct("child").alias("n")).where("n >= 2").select("root")


def stem(path: Column) -> Column:
    return F.regexp_replace(normalised(path), r"(?i)\.cshtml$", "")


def is_explicit(name: Column) -> Column:
    return F.rlike(normalised(name), F.lit(r"(?i)^[~/]|\.cshtml$"))


def ancestors(path: Column) -> Column:
    """The directory of a path and all above it, nearest first, the root ('') last."""
    parts = F.split(normalised(F.coalesce(path, F.lit(""))), "/")
    n = F.size(parts) - 1
    return F.transform(F.sequence(F.lit(0), n), lambda k: F.array_join(F.slice(parts, 1, n - k), "/"))


def _beside(dir_: Column, name: Column) -> Column:
    return F.when(dir_ == "", name).otherwise(F.concat(dir_, F.lit("/"), name))


def view_paths(name: Column, source: Column) -> Column:
    """Exact paths to try for a name that isn't a path, nearest first: beside the source, its shared folders, then up."""
    own = stem(name)
    tries = lambda d: F.array(_beside(d, own), *[_beside(_beside(d, F.lit(s)), own) for s in SHARED_FOLDERS])
    return F.array_distinct(F.flatten(F.transform(ancestors(source), tries)))


def resolve_views(wanted: DataFrame, templates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted``: keys, name, source, controller (null if none); ``templates``: path. All candidates: keys, path, rank from 0.

    Tiers: the controller's folder, near paths, shared roots anywhere, the file name anywhere. An
    explicit path is only ever itself. Each tier is an equi-join of its own; within one, paths go by name.
    Rows of one name, folder of the source and controller have the same candidates, which are sought once.
    """
    folder = F.regexp_replace(normalised(F.col("source")), "[^/]*$", "")
    wanted = wanted.select(*keys, "name", folder.alias("source"), "controller")
    asked = ["name", "source", "controller"]
    given = wanted.select(*keys, *[F.col(c).alias(f"__{c}") for c in asked])
    found = _candidates(wanted.select(*asked).distinct(), templates).select(*[F.col(c).alias(f"__its_{c}") for c in asked], "path", "tier")
    same = reduce(Column.__and__, [F.col(f"__{c}").eqNullSafe(F.col(f"__its_{c}")) for c in asked])
    best = given.join(found, same).groupBy(*keys, "path").agg(F.min("tier").alias("tier"))
    order = Window.partitionBy(*keys).orderBy("tier", F.lower("path"), "path")
    return best.select(*keys, "path", (F.row_number().over(order) - 1).alias("rank"))


def _candidates(wanted: DataFrame, templates: DataFrame) -> DataFrame:
    """name, source, controller, path, tier."""
    keys = ("name", "source", "controller")
    t = templates.select(normalised(F.col("path")).alias("path")).distinct().select("path", F.lower("path").alias("at"), F.lower(F.element_at(F.split("path", "/"), -1)).alias("file"))
    w = wanted.withColumn("explicit", is_explicit(F.col("name")))
    plain, exact = w.where("not explicit"), w.where("explicit")
    goal = F.lower(F.regexp_replace(normalised(F.col("name")), "^[~/]+", ""))
    found = [exact.withColumn("at", goal).join(t.drop("file"), "at").select(*keys, F.lit(0).alias("tier"), "path")]
    tail = exact.withColumn("goal", goal).withColumn("file", F.element_at(F.split("goal", "/"), -1)).join(t, "file")
    found.append(tail.where(F.endswith(F.col("at"), F.concat(F.lit("/"), F.col("goal")))).select(*keys, F.lit(0).alias("tier"), "path"))
    file = F.lower(F.concat(stem(F.col("name")), F.lit(".cshtml")))
    beside = F.coalesce("source", F.when(F.col("controller").isNotNull(), F.concat(F.lit("Views/"), "controller", F.lit("/_.cshtml"))))
    near = plain.select(*keys, F.posexplode(view_paths(F.col("name"), beside)).alias("pos", "try")).withColumn("at", F.lower(F.concat("try", F.lit(".cshtml"))))
    found.append(near.join(t.drop("file"), "at").select(*keys, (F.col("pos") + 10).alias("tier"), "path"))
    last = plain.withColumn("want", file).withColumn("file", F.element_at(F.split("want", "/"), -1)).join(t, "file")
    ends = lambda s: (F.col("at") == F.concat(F.lit(s), F.col("want"))) | F.endswith(F.col("at"), F.concat(F.lit(f"/{s}"), F.col("want")))
    mine = F.concat(F.lit("views/"), F.lower(F.col("controller")), F.lit("/"), F.col("want"))
    tier = F.when((F.col("at") == mine) | F.endswith(F.col("at"), F.concat(F.lit("/"), mine)), 1)
    for k, s in enumerate(SHARED_FOLDERS):
        tier = tier.when(ends(f"{s.lower()}/"), 100_000 + k)
    found.append(last.withColumn("tier", tier.when(F.col("file") == F.col("want"), 200_000)).where("tier is not null").select(*keys, "tier", "path"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*keys, "path").agg(F.min("tier").alias("tier"))


def shape_candidates(name: Column) -> Column:
    """File names that could serve a shape, most specific first: base_Display__Alt1__Alt2 to base-Alt1-Alt2.Display and down."""
    parts = F.filter(F.split(name, "__"), lambda p: p != "")
    head = F.filter(F.split(F.get(parts, F.lit(0)), "_"), lambda p: p != "")
    root, display, alternates = F.get(head, F.lit(0)), F.slice(head, 2, F.greatest(F.size(head), F.lit(1))), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    shown = F.array_join(F.transform(display, lambda d: F.concat(F.lit("."), d)), "")
    ladder = lambda tail: F.transform(F.reverse(F.sequence(F.lit(0), F.size(alternates))), lambda k: F.concat(F.array_join(F.concat(F.array(root), F.slice(alternates, 1, k)), "-"), tail))
    every = F.concat(ladder(shown), ladder(F.lit("")), F.array(name))
    low = F.transform(every, F.lower)
    return F.when((F.trim(name) != "") & root.isNotNull(), F.filter(every, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)).otherwise(F.array().cast("array<string>"))


def lua_module(path: Column) -> Column:
    """a/b/init.lua to a.b"""
    bare = F.regexp_replace(normalised(path), r"(?i)\.lua$", "")
    return F.replace(F.regexp_replace(bare, "/init$", ""), F.lit("/"), F.lit("."))


def lua_modules_of(sources: DataFrame, rockspec: DataFrame) -> DataFrame:
    """``sources`` (path) with ``module``: what the rockspec (module, path) says of the file, whatever its case, else by the path."""
    key = lambda c: F.lower(normalised(F.col(c)))
    named = rockspec.groupBy(key("path").alias("__at")).agg(F.min("module").alias("__named"))
    rows = sources.withColumn("__at", key("path")).join(named, "__at", "left")
    return rows.withColumn("module", F.coalesce("__named", lua_module(F.col("path")))).drop("__at", "__named")


def last_segment(name: Column) -> Column:
    return F.regexp_extract(name, r"([^.:]+)$", 1)


def version_array(text: Column) -> Column:
    """1.10 to [1, 10], comparable; null if it isn't dotted numbers."""
    return F.when(F.rlike(text, F.lit(r"^\d+(\.\d+)*$")), F.transform(F.split(text, r"\."), lambda x: x.cast("int")))
