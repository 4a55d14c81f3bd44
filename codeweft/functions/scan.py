"""Scanners of page and script texts as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

_S = r"[ \t\r\n]*"
_QUOTED = rf"(?:\x22([^\x22]*)\x22|\x27([^\x27]*)\x27)"


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def _either(text: Column, pattern: str, first: int = 1) -> Column:
    """Of a pattern that ends in a quoted value: the values in double and in single quotes."""
    both = F.arrays_zip(_all(text, pattern, first).alias("a"), _all(text, pattern, first + 1).alias("b"))
    return F.transform(both, lambda m: F.when(m["a"] != "", m["a"]).otherwise(m["b"]))


def _some(found: Column) -> Column:
    return F.array_distinct(F.filter(found, lambda x: x != ""))


def _lower(found: Column) -> Column:
    return F.transform(found, F.lower)


# Names


def kebab(name: Column) -> Column:
    """fooBar to foo-bar, as the DOM names data attributes."""
    return F.lower(F.regexp_replace(name, r"(\p{Lu})", "-$1"))


def asset_path(href: Column) -> Column:
    """The path under the web root; null for other hosts and for nothing."""
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(href, r"(?s)[?#].*$", ""), "^~+", ""), r"^[/\\]+", "")
    outside = F.rlike(F.lower(href), F.lit(r"^(?:https?:)?//|^https?:")) | (F.trim(href) == "") | (path == "")
    return F.when(~outside, F.replace(path, F.lit("\\"), F.lit("/")))


# Scripts


def strip_script_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(?s)/[*].*?[*]/", ""), r"(?m)^[ \t]*//.*$", "")


def _keys(text: Column, writes: bool) -> Column:
    sets = "(?:set|remove)" if writes else "(?:get|set|has|remove)"
    dataset = rf"[.]dataset{_S}[.]{_S}([\p{{Alpha}}_][$\w]*)" + (rf"{_S}=(?!=)" if writes else "")
    found = F.concat(F.transform(_all(text, dataset), kebab), _lower(_all(text, rf"{sets}Attribute{_S}[(]{_S}[\x22\x27]data-([-\w]+)[\x22\x27]")))
    return found if writes else F.concat(found, _lower(_all(text, rf"\x5B{_S}data-([-\w]+)")))


def data_keys(script: Column) -> Column:
    """data-* keys that a script touches, in kebab case."""
    return _some(_keys(strip_script_comments(script), False))


def data_keys_written(script: Column) -> Column:
    return _some(_keys(strip_script_comments(script), True))


def read_only_keys(script: Column) -> Column:
    return F.array_except(data_keys(script), data_keys_written(script))


_BY_ID = rf"getElementById{_S}[(]{_S}([\x22\x27])([^\x22\x27]+)\1{_S}[)]"
_BY_QUERY = rf"querySelector(?:All|){_S}[(]{_S}([\x22\x27])([^\x22\x27]+)\1{_S}[)]"
_BY_JQUERY = rf"\x24{_S}[(]{_S}([\x22\x27])([#.\x5B][^\x22\x27]*)\1{_S}[)]"


def selector_ids(script: Column) -> Column:
    """Ids in literal selectors, but those that the script gives to elements of its own."""
    text = strip_script_comments(script)
    tokens = lambda sel: _all(sel, r"#([\p{Alpha}_][-\w]*)")
    found = F.concat(_all(text, _BY_ID, 2), F.flatten(F.transform(_all(text, _BY_QUERY, 2), tokens)), F.flatten(F.transform(_all(text, _BY_JQUERY, 2), tokens)))
    return _some(found)


def own_ids(script: Column) -> Column:
    text = strip_script_comments(script)
    return _some(F.concat(_all(text, rf"[.]id{_S}={_S}([\x22\x27])([\p{{Alpha}}_][-\w]*)\1", 2), _all(text, rf"id{_S}={_S}\\?[\x22\x27]([\p{{Alpha}}_][-\w]*)\\?[\x22\x27]")))


def foreign_ids(script: Column) -> Column:
    return F.array_except(selector_ids(script), own_ids(script))


def dynamic_selectors(script: Column) -> Column:
    """Selector calls whose argument isn't one literal."""
    text = strip_script_comments(script)
    every = F.size(_all(text, rf"(?:getElementById|querySelector(?:All|)){_S}[(]", 0))
    return F.greatest(F.lit(0), every - F.size(_all(text, _BY_ID, 0)) - F.size(_all(text, _BY_QUERY, 0)))


def api_calls(script: Column) -> Column:
    text = strip_script_comments(script)
    fetched = _all(text, rf"fetch{_S}[(]{_S}[\x22\x27`]([^\x22\x27`$]+)")
    jquery = _all(text, rf"(?:\burl{_S}:{_S}|[$][.](?:getJSON|get|post){_S}[(]{_S})[\x22\x27](/[^\x22\x27]+)")
    return F.array_distinct(F.filter(F.transform(F.concat(fetched, jquery), lambda x: F.trim(x)), lambda u: F.startswith(u, F.lit("/"))))


def api_segment(url: Column) -> Column:
    """X of /api/X/...; null for other URLs."""
    parts = F.filter(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), lambda p: p != "")
    return F.when(F.lower(F.get(parts, F.lit(0))) == "api", F.get(parts, F.lit(1)))


# Pages


@pandas_udf(T.StringType())
def strip_page_comments(texts: pd.Series) -> pd.Series:
    """Without @* *@ comments, but with their line breaks."""
    import re

    found = re.compile(r"@[*].*?[*]@", re.DOTALL)
    return texts.map(lambda t: None if t is None else found.sub(lambda m: "\n" * m.group().count("\n"), t))


@pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("is_tag", T.BooleanType()), T.StructField("line", T.IntegerType())])))
def partial_renders(texts: pd.Series) -> pd.Series:
    """Partials that a page renders, with lines: tags first, then calls."""
    import re

    s = r"[ \t\r\n]*"
    tag = re.compile(rf"<partial[ \t\r\n]+name{s}={s}[\"']([^\"']+)[\"']")
    calls = [re.compile(rf"{n}{s}[(]{s}[\"']([^\"']+)[\"']") for n in ("RenderPartialAsync", r"Html[.]PartialAsync")]

    def of(text: str | None) -> list[dict]:
        text = text or ""
        line = lambda m: text.count("\n", 0, m.start()) + 1
        tags = [{"name": m[1], "is_tag": True, "line": line(m)} for m in tag.finditer(text)]
        return tags + [{"name": m[1], "is_tag": False, "line": line(m)} for p in calls for m in p.finditer(text)]

    return texts.map(of)


@pandas_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("line", T.IntegerType())])))
def tag_helpers(texts: pd.Series) -> pd.Series:
    """Tags with an asp-* attribute."""
    import re

    tag = re.compile(r"<([A-Za-z][-\w]*)((?:\s+[-\w]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?)+)\s*/?>")
    attribute = re.compile(r"([-\w]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")

    def of(text: str | None) -> list[dict]:
        out = []
        for m in tag.finditer(text or ""):
            own = [(a[1], a[2] if a[2] is not None else a[3]) for a in attribute.finditer(m[2])]
            if any(n.lower().startswith("asp-") for n, _ in own):
                out.append({"tag": m[1], "attributes": dict(own), "line": text.count("\n", 0, m.start()) + 1})
        return out

    return texts.map(of)


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def route_template(text: Column) -> Column:
    return _first(text, r"(?m)^\s*@page[ \t]+[\x22\x27]([^\x22\x27]*)[\x22\x27]")


def is_page(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?m)^\s*@page(?:[ \t]+[\x22\x27][^\x22\x27]*[\x22\x27])?[ \t]*\r?$"))


def model_directive(text: Column) -> Column:
    return F.trim(_first(text, r"(?m)^\s*@model[ \t]+([^\n\r]+)"))


def inject_directives(text: Column) -> Column:
    return F.transform(_all(text, r"(?m)^\s*@inject[ \t]+([^\n\r]+)"), lambda x: F.trim(x))


def sections(text: Column) -> Column:
    return _all(text, r"@section[ \t]+(\w+)")


def view_data_keys(text: Column) -> Column:
    return F.array_distinct(_all(text, r"ViewData\x5B[\x22\x27]([^\x22\x27]+)[\x22\x27]\x5D"))


def layout(text: Column) -> Column:
    """From the assignment, else from the directive."""
    return F.coalesce(_first(text, rf"Layout{_S}={_S}[\x22\x27]([^\x22\x27]+)[\x22\x27]"), F.regexp_replace(_first(text, r"(?m)^\s*@layout[ \t]+(\S+)"), r"^[\x22\x27]+|[\x22\x27]+$", ""))


def asset_references(text: Column) -> Column:
    """src of scripts, then href of style sheets, as written; once each but for case."""
    found = F.concat(_all(text, rf"(?i)<script\b[^>]*?\bsrc{_S}={_S}[\x22\x27]([^\x22\x27]+)[\x22\x27]"), _all(text, rf"(?i)<link\b[^>]*?\bhref{_S}={_S}[\x22\x27]([^\x22\x27]+[.]css[^\x22\x27]*)[\x22\x27]"))
    found = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: x != "")
    lowered = _lower(found)
    return F.filter(found, lambda x, i: F.array_position(lowered, F.lower(x)) == i + 1)


def inline_scripts(text: Column) -> Column:
    """Bodies of script blocks without src."""
    tag = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
    blocks = F.arrays_zip(_all(text, tag, 1).alias("attrs"), _all(text, tag, 2).alias("body"))
    own = F.filter(blocks, lambda b: ~F.rlike(b["attrs"], F.lit(r"(?i)\bsrc\s*=")) & (F.trim(F.regexp_replace(b["body"], r"\s", "")) != ""))
    return F.transform(own, lambda b: b["body"])


def bound_data_keys(text: Column) -> Column:
    """data-* keys whose value the server computes."""
    return F.array_distinct(_lower(F.concat(_all(text, rf"\bdata-([-\w]+){_S}={_S}\x22[^\x22]*@[^\x22]*\x22"), _all(text, rf"\bdata-([-\w]+){_S}={_S}\x27[^\x27]*@[^\x27]*\x27"))))


def rendered_data_keys(text: Column) -> Column:
    return F.array_distinct(_lower(_all(text, rf"\bdata-([-\w]+){_S}={_S}[\x22\x27]")))


def _ids(text: Column) -> Column:
    return F.transform(_either(text, rf"\bid{_S}={_S}{_QUOTED}"), lambda x: F.trim(x))


def rendered_ids(text: Column) -> Column:
    """Literal ids, and those that asp-for makes of a property path."""
    fixed = F.filter(_ids(text), lambda v: (v != "") & ~F.contains(v, F.lit("@")))
    bound = F.filter(_either(text, rf"\basp-for{_S}={_S}{_QUOTED}"), lambda v: (v != "") & ~F.contains(v, F.lit("@")))
    return F.array_distinct(F.concat(fixed, F.transform(bound, lambda v: F.replace(F.translate(F.trim(v), ".[", "__"), F.lit("]"), F.lit("")))))


def dynamic_ids(text: Column) -> Column:
    return F.size(F.filter(_ids(text), lambda v: F.contains(v, F.lit("@"))))
