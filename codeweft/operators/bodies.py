"""Method bodies as control-flow graphs, and whether two of them do the same.

``blocks``: body, ordinal, kind, operations, calls (target ids in order), condition, when_true,
when_false, falls_to, region; ``regions``: body, id, parent, kind, exception_type. Bodies are small; a
pair of them is walked in one task, and pairs in parallel.
"""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

MOST_DIFFERENCES = 25
BLOCK = ("ordinal", "kind", "operations", "calls", "condition", "when_true", "when_false", "falls_to", "region")
REGION = ("id", "parent", "kind", "exception_type")
#: Results that are kept in a batch, of pairs that have fewer characters than this together.
MOST_KEPT, LONGEST_KEPT = 4096, 8192
OUTER = ("Root", "LocalLifetime")


def _none(x):
    return None if x is None or (isinstance(x, float) and x != x) else x


def _context(region: int, regions: dict[int, dict], handlers: dict[int, list[str]]) -> str:
    """The try, catch and finally regions that a block stands in, innermost first."""
    names = []
    while region is not None and region in regions:
        r = regions[region]
        if r["kind"] not in OUTER:
            own = r["name"]
            names.append(f"{own}({','.join(handlers.get(region, []))})" if r["kind"] in ("TryAndCatch", "TryAndFinally") else own)
        region = r["parent"]
    return " > ".join(names)


def compare_bodies(left: list[dict], right: list[dict], left_regions: list[dict], right_regions: list[dict]) -> list[str]:
    """Differences found walking both bodies in step from their entries; at most MOST_DIFFERENCES."""

    def prepared(rows: list[dict]):
        by = {r["id"]: {"kind": r["kind"], "parent": _none(r["parent"]), "name": r["kind"] + (f":{r['exception_type']}" if _none(r["exception_type"]) else "")} for r in rows}
        inner: dict[int, list[str]] = {}
        for r in by.values():
            if r["parent"] is not None and r["kind"] != "Try":
                inner.setdefault(r["parent"], []).append(r["name"])
        return by, inner

    a_regions, b_regions = prepared(left_regions), prepared(right_regions)
    a_blocks, b_blocks = {b["ordinal"]: b for b in left}, {b["ordinal"]: b for b in right}
    entry = lambda rows: next((b["ordinal"] for b in rows if b["kind"] == "Entry"), None)
    todo, seen, found = [(entry(left), entry(right))], set(), []
    if None in todo[0]:
        return [f"L{todo[0][0]}/R{todo[0][1]}: no entry"]
    while todo and len(found) < MOST_DIFFERENCES:
        pair = todo.pop(0)
        if pair in seen:
            continue
        seen.add(pair)
        a, b = a_blocks[pair[0]], b_blocks[pair[1]]
        at = f"L{pair[0]}/R{pair[1]}"
        checks = [
            ("kind", a["kind"], b["kind"]), ("operations", a["operations"] or [], b["operations"] or []), ("calls", a["calls"] or [], b["calls"] or []), ("condition", _none(a["condition"]), _none(b["condition"])),
            ("exception context", _context(_none(a["region"]), *a_regions), _context(_none(b["region"]), *b_regions)),
        ]
        bad = next(((what, x, y) for what, x, y in checks if x != y), None)
        if bad:
            found.append(f"{at}: {bad[0]} {bad[1]} <> {bad[2]}")
            continue
        for way in ("when_true", "when_false") if _none(a["condition"]) is not None else ("falls_to",):
            x, y = _none(a[way]), _none(b[way])
            if (x is None) != (y is None):
                found.append(f"{at}: {way} on one side only")
            elif x is not None:
                todo.append((int(x), int(y)))
    return found


@pandas_udf(StructType([StructField(n, ArrayType(StringType())) for n in ("differences", "calls_only_left", "calls_only_right")]))
def _compared(left: pd.Series, right: pd.Series) -> pd.DataFrame:
    """Of the JSON texts of two bodies: their differences, and the calls that one has more often, sorted."""
    blank = dict.fromkeys(BLOCK + REGION)
    known: dict[tuple[str, str], tuple] = {}

    def parsed(text: str | None) -> tuple[list[dict], list[dict]]:
        found = json.loads(text) if text is not None else {}
        return tuple([blank | row for row in found.get(part) or ()] for part in ("blocks", "regions"))

    def more(a: Counter, b: Counter) -> list:
        return sorted((a - b).elements(), key=lambda x: (x is not None, x or ""))

    def compare(x: str | None, y: str | None) -> tuple:
        (a, a_regions), (b, b_regions) = parsed(x), parsed(y)
        calls = [Counter(c for block in blocks for c in block["calls"] or ()) for blocks in (a, b)]
        return compare_bodies(a, b, a_regions, b_regions), more(*calls), more(*calls[::-1])

    out = []
    for pair in zip(left, right, strict=True):
        found = known.get(pair) or compare(*pair)
        # Bodies often repeat; long ones aren't kept.
        if len(known) < MOST_KEPT and sum(len(x or "") for x in pair) < LONGEST_KEPT:
            known[pair] = found
        out.append(found)
    return pd.DataFrame(out, columns=["differences", "calls_only_left", "calls_only_right"])


def body_texts(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """body, text: a row a body, its blocks and regions as JSON, in the order of their numbers."""
    rows = blocks.select("body", F.struct(*BLOCK).alias("b"), F.lit(None).cast(_struct(regions, REGION)).alias("r"))
    rows = rows.unionByName(regions.select("body", F.lit(None).cast(_struct(blocks, BLOCK)).alias("b"), F.struct(*REGION).alias("r")))
    rows = rows.groupBy("body").agg(F.array_sort(F.collect_list("b")).alias("blocks"), F.array_sort(F.collect_list("r")).alias("regions"))
    return rows.select("body", F.to_json(F.struct("blocks", "regions")).alias("text"))


def _struct(rows: DataFrame, names: tuple[str, ...]) -> StructType:
    return StructType([StructField(n, rows.schema[n].dataType) for n in names])


def body_diff(pairs: DataFrame, blocks: DataFrame, regions: DataFrame, depths: DataFrame) -> DataFrame:
    """``pairs``: pair, left, right; ``depths``: body, depth. pair, equivalent, depth_left, depth_right, calls_only_left, calls_only_right, differences.

    A body is one text, gathered once; pairs of texts are compared in Arrow batches, equal ones once a batch.
    """
    bodies = body_texts(blocks, regions).join(depths.select("body", "depth"), "body", "left")
    side = lambda s: bodies.select(F.col("body").alias(s), F.col("text").alias(f"{s}_text"), F.col("depth").alias(f"depth_{s}"))
    rows = pairs.select("pair", "left", "right").join(side("left"), "left", "left").join(side("right"), "right", "left").where("left_text is not null or right_text is not null")
    rows = rows.withColumn("c", _compared("left_text", "right_text")).select("pair", "depth_left", "depth_right", "c.*")
    equal = (F.size("differences") == 0) & (F.size("calls_only_left") == 0) & (F.size("calls_only_right") == 0)
    return rows.select("pair", equal.alias("equivalent"), "depth_left", "depth_right", "calls_only_left", "calls_only_right", "differences")


_COMPLEMENT = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


def canonical_condition(condition: str, negated: bool = False, floating: bool = False) -> tuple[str, bool]:
    """A branch condition without leading negations and, unless floats are compared, with ``==``, ``<`` or ``<=``; and whether its branches swap."""
    text = condition.strip()
    while text.startswith("!") and not text.startswith("!="):
        text, negated = text[1:].strip(), not negated
        if text.startswith("(") and text.endswith(")"):
            text = text[1:-1].strip()
    for op in ("!=", ">=", ">"):
        head, found, tail = text.partition(f" {op} ")
        if found and not floating:
            return f"{head} {_COMPLEMENT[op]} {tail}", not negated
    return text, negated
