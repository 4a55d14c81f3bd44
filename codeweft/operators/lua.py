"""Lua modules: resolution of requires and calls, versions, reachability and rule findings.

Facts: ``modules`` (module, path, host), ``functions`` (module, name, line), ``references`` (module,
name, line, kind: require or import), ``calls`` (module, function, callee, receiver, method, line),
``rejections`` (path, line, message), ``manifest`` (path, key, value). The catalogue of a host's API
is a table: module, function, since, retired, documented; ``allowed``: function, position, value, since.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import last_segment, version_array
from ..store import settled
from .traverse import bfs

STANDARD = (
    "print error assert type tostring tonumber pcall xpcall select unpack "
    "pairs ipairs next rawget rawset rawequal rawlen "
    "getmetatable setmetatable getfenv setfenv "
    "require load loadstring loadfile dofile collectgarbage"
).split()
STANDARD_TABLES = "string table math os io debug coroutine utf8 bit bit32 package jit".split()
SEVERITIES = ("Error", "Warning", "Note")
FINDING = ["rule", "severity", "path", "line", "message"]


def module_nodes(modules: DataFrame) -> DataFrame:
    return modules.groupBy("module").agg(F.min("path").alias("file_path"), F.min("host").alias("host")).select(
        F.concat(F.lit("mod:"), "module").alias("node_id"), F.lit("Unknown").alias("type"), F.lit("luaModule").alias("foreign_type"), F.col("module").alias("name"), "file_path", F.to_json(F.struct("host", F.col("file_path").alias("relativePath"))).alias("props")
    )


def function_nodes(functions: DataFrame) -> DataFrame:
    rows = functions.dropDuplicates(["module", "name", "line"])
    return rows.select(F.concat(F.lit("mod:"), "module", F.lit("."), "name", F.lit("#"), "line").alias("node_id"), F.lit("Method").alias("type"), "name", F.concat(F.lit("mod:"), "module").alias("declaring_type"), F.col("line").alias("line_start"))


def external_nodes(resolved: DataFrame) -> DataFrame:
    """Nodes of the host's functions that calls lead to, once each."""
    rows = resolved.where("outcome = 'external'").select("target").distinct()
    return rows.select(F.col("target").alias("node_id"), F.lit("Method").alias("type"), F.regexp_replace("target", "^ext:", "").alias("name"), F.to_json(F.struct(F.lit(True).alias("external"))).alias("props"))


def resolved_references(references: DataFrame, modules: DataFrame, external: DataFrame) -> DataFrame:
    """Each reference with target (module) and outcome: inGraph, external or unresolved. ``external``: module."""
    own = modules.select(F.col("module").alias("target"), F.explode(F.array_distinct(F.array("module", F.concat("module", F.lit(".init")), last_segment(F.col("module"))))).alias("name"))
    exact = own.groupBy("name").agg(F.min_by("target", F.struct(F.col("target") != F.col("name"), F.col("target"))).alias("target"))
    name = F.replace(F.regexp_replace("name", r"\.lua$", ""), F.lit("/"), F.lit("."))
    rows = references.withColumn("name", name).join(exact, "name", "left").join(external.select(F.col("module").alias("name"), F.lit(True).alias("is_external")), "name", "left")
    outcome = F.when(F.col("target").isNotNull(), "inGraph").when(F.col("is_external"), "external").otherwise("unresolved")
    return rows.withColumn("outcome", outcome).drop("is_external")


def resolved_calls(calls: DataFrame, bindings: DataFrame, functions: DataFrame, catalogue: DataFrame, instance_methods: DataFrame) -> DataFrame:
    """Each call with outcome and target; the first rule that fits counts.

    ``bindings``: module, local, target, external. Rules: a local bound to a module in the graph, one
    bound to a host's module, a function of the same module, the standard library, a method that the
    host's objects have; else unresolved.
    """
    first = functions.groupBy("module", "name").agg(F.min("line").alias("at"))
    rows = calls.join(bindings.select("module", F.col("local").alias("receiver"), F.col("target").alias("bound"), "external"), ["module", "receiver"], "left")
    there = first.select(F.col("module").alias("bound"), F.col("name").alias("method"), F.col("at").alias("bound_at"))
    rows = rows.join(there, ["bound", "method"], "left").join(first.select("module", F.col("name").alias("callee"), F.col("at").alias("own_at")), ["module", "callee"], "left")
    rows = rows.join(instance_methods.select(F.col("method"), F.lit(True).alias("on_instance")).distinct(), "method", "left")
    bound_in, bound_out = F.col("bound").isNotNull() & ~F.coalesce("external", F.lit(False)), F.coalesce("external", F.lit(False))
    standard = F.col("callee").isin(*STANDARD) | F.col("receiver").isin(*STANDARD_TABLES)
    outcome = (
        F.when(bound_in & F.col("bound_at").isNotNull(), "module").when(bound_out, "external").when(F.col("receiver").isNull() & F.col("own_at").isNotNull(), "sameModule").when(standard, "standard").when(F.col("on_instance"), "instance").otherwise("unresolved")
    )
    target = (
        F.when(outcome == "module", F.concat(F.lit("mod:"), "bound", F.lit("."), "method", F.lit("#"), "bound_at")).when(outcome == "external", F.concat(F.lit("ext:"), "bound", F.lit("."), "method"))
        .when(outcome == "sameModule", F.concat(F.lit("mod:"), "module", F.lit("."), "callee", F.lit("#"), "own_at"))
    )
    return rows.withColumns({"outcome": outcome, "target": target}).select(*calls.columns, "outcome", "target")


def call_report(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("outcome").agg(F.count("*").alias("n"))


def external_calls(resolved: DataFrame, by: Sequence[str] = ("module",)) -> DataFrame:
    """module, functions (sorted) of the host's API that each module calls; with ``by`` module and function, of each function."""
    return resolved.where("outcome = 'external'").groupBy(*by).agg(F.sort_array(F.collect_set(F.regexp_replace("target", "^ext:", ""))).alias("functions"))


def verdicts(used: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``used``: function. Known, KnownUndocumented or Unknown."""
    rows = used.join(catalogue.select(F.concat("module", F.lit("."), "function").alias("function"), "documented", F.lit(True).alias("there")), "function", "left")
    return rows.withColumn("verdict", F.when(F.col("there") & F.coalesce("documented", F.lit(False)), "Known").when(F.col("there"), "KnownUndocumented").otherwise("Unknown")).drop("there", "documented")


def version_floor(uses: DataFrame, catalogue: DataFrame) -> DataFrame:
    """``uses``: plugin, function. plugin, version, drivers: the highest version that what it uses needs, and what needs it. Versions that aren't numbers are left out."""
    since = catalogue.select(F.concat("module", F.lit("."), "function").alias("function"), F.col("since").alias("version"), version_array(F.col("since")).alias("v")).where("v is not null")
    rows = uses.join(since, "function")
    most = rows.groupBy("plugin").agg(F.max("v").alias("v"))
    return rows.join(most, ["plugin", "v"]).groupBy("plugin").agg(F.min("version").alias("version"), F.sort_array(F.collect_set("function")).alias("drivers"))


def minimum_versions(uses: DataFrame, catalogue: DataFrame, modules: DataFrame) -> DataFrame:
    """``uses``: module, function; ``modules``: module, since. module, version: the highest that a used function needs; the module's own where the catalogue knows none of them. Modules that aren't catalogued are left out."""
    rows = uses.join(catalogue.select("module", "function", F.col("since").alias("version"), version_array(F.col("since")).alias("v")), ["module", "function"], "left")
    most = rows.groupBy("module").agg(F.max_by("version", "v").alias("called"))
    return most.join(modules, "module").select("module", F.coalesce("called", "since").alias("version"))


def floors_with_imports(imports: DataFrame, uses: DataFrame, catalogue: DataFrame, modules: DataFrame) -> DataFrame:
    """``imports``: plugin, module; ``uses``: plugin, function. plugin, version, drivers: a higher need replaces, an equal one joins; what is only imported says so."""
    by_import = imports.join(modules, "module").select("plugin", "since", F.concat("module", F.lit(" ("), "since", F.lit(", imported)")).alias("driver"), F.lit(0).alias("way"))
    known = catalogue.select(F.concat("module", F.lit("."), "function").alias("function"), "since")
    by_call = uses.join(known, "function").select("plugin", "since", F.concat("function", F.lit(" ("), "since", F.lit(")")).alias("driver"), F.lit(1).alias("way"))
    rows = by_import.unionByName(by_call).distinct().withColumn("v", version_array(F.col("since"))).where("v is not null")
    most = rows.groupBy("plugin").agg(F.max("v").alias("v"))
    return rows.join(most, ["plugin", "v"]).groupBy("plugin").agg(F.min("since").alias("version"), F.array_sort(F.collect_list(F.struct("way", "driver"))).alias("d")).select("plugin", "version", F.col("d.driver").alias("drivers"))


def reachable_modules(roots: DataFrame, references: DataFrame) -> DataFrame:
    """``roots``: module; ``references`` resolved. module of all that the roots require, directly or not."""
    steps = settled(references.where("outcome = 'inGraph'").select(F.col("module").alias("src"), F.col("target").alias("dst"), F.lit(0).cast("long").alias("edge_seq")).distinct(), "requires")
    return bfs(roots.select(F.col("module").alias("node")), steps, None).select(F.col("node").alias("module"))


# Rules: each gives FINDING columns


def _finding(rows: DataFrame, rule: str, severity: str | Column, path: str | Column, line: Column, message: Column) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.col(path) if isinstance(path, str) else path).alias("path"), line.cast("int").alias("line"), message.alias("message"))


def dialect(rejections: DataFrame) -> DataFrame:
    """One Error a file, at its first rejection."""
    rows = rejections.groupBy("path").agg(F.min_by(F.struct("line", "message"), "line").alias("r"), F.count("*").alias("n"))
    return _finding(rows, "lua.dialect", "Error", "path", F.col("r.line"), F.concat("r.message", F.when(F.col("n") > 1, F.concat(F.lit(" (and "), (F.col("n") - 1).cast("string"), F.lit(" more)"))).otherwise("")))


def sdk_surface(resolved: DataFrame, modules: DataFrame, catalogue: DataFrame, shown: int = 8) -> DataFrame:
    """Retired functions are errors; functions that the catalogue lacks are noted, the first few by name."""
    used = resolved.where("outcome = 'external'").withColumn("full", F.regexp_replace("target", "^ext:", "")).join(modules.select("module", "path"), "module")
    known = catalogue.select(F.concat("module", F.lit("."), "function").alias("full"), "retired", F.lit(True).alias("there"))
    rows = used.join(known, "full", "left")
    retired = rows.where("retired is not null").groupBy("path", "full", "retired").agg(F.min("line").alias("line"))
    unknown = rows.where("there is null").groupBy("path").agg(F.min("line").alias("line"), F.sort_array(F.collect_set("full")).alias("names"))
    return _finding(retired, "sdk.surface", "Error", "path", F.col("line"), F.concat("full", F.lit(" was retired in "), "retired")).unionByName(
        _finding(unknown, "sdk.surface", "Note", "path", F.col("line"), F.concat(F.lit("not in the catalogue: "), F.array_join(F.slice("names", 1, shown), ", ")))
    )


def sdk_arguments(arguments: DataFrame, allowed: DataFrame, floors: DataFrame) -> DataFrame:
    """``arguments``: path, plugin, line, function, position, value of literal arguments; only functions with a list of values are judged."""
    listed = allowed.select("function", "position").distinct()
    rows = arguments.join(listed, ["function", "position"], "left_semi").join(allowed.select("function", "position", "value", F.col("since").alias("needs"), F.lit(True).alias("there")), ["function", "position", "value"], "left")
    rows = rows.join(floors.select("plugin", F.col("version").alias("floor")), "plugin", "left")
    unknown = _finding(rows.where("there is null"), "sdk.argument", "Warning", "path", F.col("line"), F.concat(F.lit("undocumented value "), "value", F.lit(" for "), "function"))
    newer = rows.where(F.col("there") & (version_array(F.col("needs")) > version_array(F.col("floor"))))
    return unknown.unionByName(_finding(newer, "sdk.argument", "Warning", "path", F.col("line"), F.concat("value", F.lit(" needs "), "needs", F.lit(", the plug-in declares "), "floor")))


def manifest_rule(manifest: DataFrame, required: Sequence[str], known: Sequence[str], floors: DataFrame, version_key: str) -> DataFrame:
    """``manifest``: plugin, path, key, value, line. Missing keys, keys outside the vocabulary, a declared version below what is needed."""
    plugins = manifest.groupBy("plugin").agg(F.min("path").alias("path"))
    missing = plugins.withColumn("key", F.explode(F.array(*map(F.lit, required)))).join(manifest.select("plugin", "key"), ["plugin", "key"], "left_anti") if required else plugins.withColumn("key", F.lit("")).limit(0)
    odd = manifest.where(~F.col("key").isin(*known)).groupBy("plugin", "path").agg(F.sort_array(F.collect_set("key")).alias("keys"), F.min("line").alias("line"))
    declared = manifest.where(F.col("key") == version_key).join(floors.select("plugin", F.col("version").alias("needed")), "plugin")
    low = declared.where(version_array(F.col("value")) < version_array(F.col("needed")))
    out = _finding(missing, "sdk.manifest", "Error", "path", F.lit(1), F.concat(F.lit("missing key "), "key"))
    out = out.unionByName(_finding(odd, "sdk.manifest", "Note", "path", F.col("line"), F.concat(F.lit("unknown keys: "), F.array_join("keys", ", "))))
    return out.unionByName(_finding(low, "sdk.manifest", "Warning", "path", F.col("line"), F.concat(F.lit("declares "), "value", F.lit(" but needs "), "needed")))


def unreachable(modules: DataFrame, roots: DataFrame, references: DataFrame) -> DataFrame:
    """Files that no manifest entry leads to; nothing if there are no roots."""
    if roots.isEmpty():
        return _finding(modules.limit(0), "sdk.unreachable", "Warning", "path", F.lit(1), F.lit(""))
    rows = modules.join(reachable_modules(roots, references), "module", "left_anti")
    return _finding(rows, "sdk.unreachable", "Warning", "path", F.lit(1), F.concat("module", F.lit(" is not reached from the manifest")))


def run_rules(rules: Sequence[Callable[[], DataFrame]]) -> tuple[DataFrame | None, list[str]]:
    """All findings, worst first; a rule that can't be planned is left out and named."""
    found, failed = None, []
    for rule in rules:
        try:
            rows = rule().select(*FINDING)
        except Exception as e:  # noqa: BLE001
            failed.append(f"{getattr(rule, '__name__', 'rule')}: {e}")
            continue
        found = rows if found is None else found.unionByName(rows)
    if found is not None:
        order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
        found = found.orderBy(order, "path", "line", "rule")
    return found, failed


def build_counters(modules: DataFrame, functions: DataFrame, references: DataFrame) -> DataFrame:
    """files, modules (fewer if ids collide), functions, references by outcome."""
    a = modules.agg(F.count("*").alias("files"), F.countDistinct("module").alias("modules"))
    b, c = functions.agg(F.count("*").alias("functions")), references.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("inGraph", "external", "unresolved")])
    return a.withColumn("k", F.lit(0)).join(b.withColumn("k", F.lit(0)), "k").join(c.withColumn("k", F.lit(0)), "k").drop("k")


def host_of(files: DataFrame) -> DataFrame:
    """``files``: root, path. root, host: a plug-in by its Info.lua, else a rock by its shortest rockspec path, else plain."""
    low = F.lower("path")
    rows = files.groupBy("root").agg(F.bool_or(F.rlike(low, F.lit(r"(^|/)info\.lua$"))).alias("plugin"), F.min_by(F.when(F.endswith(low, F.lit(".rockspec")), F.col("path")), F.when(F.endswith(low, F.lit(".rockspec")), F.struct(F.length("path"), F.col("path")))).alias("spec"))
    return rows.select("root", F.when(F.col("plugin"), "plugin").when(F.col("spec").isNotNull(), "rock").otherwise("plain").alias("host"), "spec")
