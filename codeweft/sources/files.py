"""File scans as DataFrames, freshness against them, and the output folder."""

from __future__ import annotations

import re
import subprocess
from datetime import datetime
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.paths import is_build_output, vendor_reason
from ..model import Graph


def texts(spark: SparkSession, folder: str, *patterns: str) -> DataFrame:
    """path (relative), text of all files under a folder that fit a pattern, but build output."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(folder)
    root = re.sub(r"^file:/*", "/", folder).rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root), "")
    rows = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("text"), F.col("modificationTime").alias("modified"))
    return rows.where(~is_build_output(F.col("path")))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder, "*.cshtml", "*.razor")


def assets(spark: SparkSession, web_root: str, drop_roots: list[str] = (), manifest_dirs: list[str] = (), include_vendor: bool = False) -> tuple[DataFrame, DataFrame]:
    """Scripts and style sheets with ``vendor_reason``, and what was skipped: path, reason."""
    rows = texts(spark, web_root, "*.js", "*.css").withColumn("vendor_reason", vendor_reason(F.col("path"), drop_roots, manifest_dirs))
    skipped = rows.where("vendor_reason is not null").select("path", F.col("vendor_reason").alias("reason"))
    return (rows, skipped.limit(0)) if include_vendor else (rows.where("vendor_reason is null"), skipped)


def skip_summary(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


def lua_sources(spark: SparkSession, folder: str, include_vendor: bool = False) -> DataFrame:
    """In the order of their paths, byte by byte."""
    rows = texts(spark, folder, "*.lua").withColumn("vendor_reason", vendor_reason(F.col("path")))
    return (rows if include_vendor else rows.where("vendor_reason is null")).orderBy("path")


def rockspec_modules(spec: DataFrame) -> DataFrame:
    """``spec``: text. module, path of each ["a.b"] = "x.lua" entry."""
    entry = r"\x5B?[\x22\x27]?([A-Za-z_][-.\w]*)[\x22\x27]?\x5D?\s*=\s*[\x22\x27]([^\x22\x27]+\.lua)[\x22\x27]"
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(entry), F.lit(1)).alias("module"), F.regexp_extract_all("text", F.lit(entry), F.lit(2)).alias("path"))
    return spec.select(F.explode(both).alias("m")).select("m.module", "m.path")


def freshness(graph: Graph, files: DataFrame) -> DataFrame:
    """node_id, written_since: true if the file changed or went, null if the graph or node can't tell. ``files``: path, modified."""
    at = F.lit(graph.built_at).cast("timestamp") if isinstance(graph.built_at, datetime) else F.lit(None).cast("timestamp")
    known = graph.nodes.where("file_path is not null").select("file_path").distinct()
    seen = known.join(files.select(F.col("path").alias("file_path"), "modified"), "file_path", "left").withColumn("changed", F.when(at.isNull(), F.lit(None).cast("boolean")).otherwise(F.col("modified").isNull() | (F.col("modified") > at)))
    return graph.nodes.select("node_id", "file_path").join(seen.select("file_path", "changed"), "file_path", "left").select("node_id", F.col("changed").alias("written_since"))


def output_folder(path: str | Path) -> tuple[Path, str | None]:
    """Makes the folder; advice if version control would pick its files up."""
    folder = Path(path)
    folder.mkdir(parents=True, exist_ok=True)
    try:
        done = subprocess.run(["git", "check-ignore", "-q", str(folder)], cwd=folder, timeout=3, capture_output=True)
    except (OSError, subprocess.TimeoutExpired):
        return folder, None
    return folder, f"add {folder.name}/ to .gitignore" if done.returncode == 1 else None


_TEXT, _TEXTS = T.StringType(), T.ArrayType(T.StringType())
_PLACEMENT = T.ArrayType(
    T.StructType(
        [T.StructField("shape", _TEXT), T.StructField("line", T.IntegerType())]
        + [T.StructField(n, _TEXT) for n in ("place", "display_type", "differentiator", "renamed_to")]
        + [T.StructField(n, _TEXTS) for n in ("alternates", "wrappers", "filters")]
    )
)


@pandas_udf(_PLACEMENT)
def placement_rules(texts: pd.Series) -> pd.Series:
    """The rules of a placement file: JSON that may hold comments and last commas."""
    import json

    def bare(text: str) -> str:
        """Comments blanked out and last commas dropped, at equal offsets."""
        out, i, n = list(text), 0, len(text)
        while i < n:
            if text[i] == '"':
                i += 1
                while i < n and text[i] != '"':
                    i += 2 if text[i] == "\\" else 1
                i += 1
            elif text.startswith(("//", "/*"), i):
                end = text.find("\n", i) if text[i + 1] == "/" else text.find("*/", i) + 2
                end = n if end < i + 2 else end
                for k in range(i, end):
                    if out[k] != "\n":
                        out[k] = " "
                i = end
            else:
                i += 1
        body = "".join(out)
        return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or " ", body)

    def of(text: str | None) -> list[dict]:
        try:
            body = bare(text or "")
            root = json.loads(body)
        except ValueError:
            return []
        if not isinstance(root, dict):
            return []
        lines: dict[str, int] = {}
        depth = 0
        for m in re.finditer(r'"((?:\\.|[^"\\])*)"(\s*:)?|[{}\[\]]', body):
            if m[0] in "{[":
                depth += 1
            elif m[0] in "}]":
                depth -= 1
            elif m[2] and depth == 1:
                lines.setdefault(json.loads(f'"{m[1]}"'), body.count("\n", 0, m.start()) + 1)
        text_of = lambda v: v if isinstance(v, str) else None
        many = lambda v: [x for x in ([v] if isinstance(v, str) else v if isinstance(v, list) else []) if isinstance(x, str) and x]
        named = {"place", "displayType", "differentiator", "shape", "alternates", "wrappers"}
        return [
            {
                "shape": shape, "line": lines.get(shape, 0), "place": text_of(r.get("place")), "display_type": text_of(r.get("displayType")), "differentiator": text_of(r.get("differentiator")),
                "renamed_to": text_of(r.get("shape")), "alternates": many(r.get("alternates")), "wrappers": many(r.get("wrappers")), "filters": [k for k in r if k not in named],
            }
            for shape, rules in root.items() if isinstance(rules, list) for r in rules if isinstance(r, dict)
        ]

    return texts.map(of)


def placements(files: DataFrame) -> DataFrame:
    """``files``: path, text. A row a rule, with ``hides`` and ``unconditional``."""
    rows = files.select("path", F.explode(placement_rules("text")).alias("r")).select("path", "r.*")
    plain = (F.coalesce("display_type", F.lit("")) == "") & (F.coalesce("differentiator", F.lit("")) == "") & (F.size("filters") == 0)
    return rows.withColumn("hides", F.coalesce(F.col("place") == "-", F.lit(False))).withColumn("unconditional", plain)
