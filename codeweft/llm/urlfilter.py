"""URL filters: a blocked Bloom filter in front of an exact hash join.

``listed_urls``: each listed canonical URL sets one bit in each of the eight 32-bit lanes of one
256-bit block; the filter is a table of blocks, built by bit_or (partial sums before the shuffle).
A page's URL is looked up in its block; only possible hits go on to the exact join with the list,
which removes the false positives. The block table is broadcast while it has at most
``broadcast_blocks`` rows (about 80 bytes each); beyond that it is joined by shuffle.

``judge_urls``: rules of (verdict, host, path) come first. A rule fits its host and all subdomains
if the URL's path starts with the rule's; the longest wins. Without a rule, listed URLs are
blocked and others allowed.

Defined results: host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with
A-Z lower-cased; path goes on up to ``?``, ``#`` or the end. A null URL or one without ``://`` has
both empty, an empty canonical form, no rule and is allowed. Repeated rows are judged each; repeats
in the list change nothing. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

LANES = 8
BLOCK_BITS = 256
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, SPLIT, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Host without ``www.``, path without a last slash, query without trackers (utm_*, ref); no scheme, no fragment."""
    query = F.regexp_replace(F.coalesce(F.regexp_extract(url, SPLIT, 3), F.lit("")), r"(?:^|&)(?:utm_[^&]*|ref=[^&]*)", "")
    query = F.regexp_replace(query, "^&", "")
    bare = F.concat(F.regexp_replace(url_host(url), r"^www\.", ""), F.regexp_replace(url_path(url), "/$", ""))
    return F.when(query != "", F.concat_ws("?", bare, query)).otherwise(bare)


def _bits(c: Column) -> list[Column]:
    """One bit of 32 for each lane, from 5 bits each of a second hash."""
    h = F.xxhash64(F.lit("bits"), c)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(LANES)]


def bloom_blocks(listed: DataFrame, n_blocks: int, url_col: str = "canonical") -> DataFrame:
    """The filter: block, lane0 to lane7."""
    keys = listed.select(F.pmod(F.xxhash64(url_col), F.lit(n_blocks)).alias("block"), *[b.alias(f"lane{i}") for i, b in enumerate(_bits(F.col(url_col)))])
    return keys.groupBy("block").agg(*[F.bit_or(f"lane{i}").alias(f"lane{i}") for i in range(LANES)])


def listed_urls(pages: DataFrame, listed: DataFrame, url_col: str = "canonical", bits_per_url: int = 12, broadcast_blocks: int = 250_000) -> DataFrame:
    """``pages`` with ``listed`` boolean. ``listed``: one column ``canonical``, distinct or not. No rows are added or lost."""
    listed = listed.select(F.col("canonical").alias("on_list")).where("on_list <> ''").distinct()
    listed = written(listed, "url-list")
    n_blocks = max(1, -(-listed.count() * bits_per_url // BLOCK_BITS))
    blocks = bloom_blocks(listed, n_blocks, "on_list")
    if n_blocks <= broadcast_blocks:
        blocks = F.broadcast(blocks)
    probes = pages.withColumn("block", F.pmod(F.xxhash64(url_col), F.lit(n_blocks)))
    found = probes.join(blocks, "block", "left")
    hit = F.coalesce(F.col("lane0").bitwiseAND(_bits(F.col(url_col))[0]) != 0, F.lit(False))
    for i, bit in enumerate(_bits(F.col(url_col))[1:], 1):
        hit = hit & F.coalesce(F.col(f"lane{i}").bitwiseAND(bit) != 0, F.lit(False))
    names = pages.columns
    found = found.select(*names, hit.alias("may_hit"))
    sure = found.where("may_hit").join(listed, F.col(url_col) == F.col("on_list"), "left")
    return found.where("not may_hit").select(*names, F.lit(False).alias("listed")).unionByName(sure.select(*names, F.col("on_list").isNotNull().alias("listed")))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, canonical, listed; a row a page."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"), canonical_url(url).alias("canonical"))
    judged = listed_urls(parts, listed)
    rule = verdict = None
    for what, host, path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, host + path) if rule is None else rule.when(fits, host + path)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (own if verdict is None else F.coalesce(verdict, own)).alias("verdict"), "canonical", "listed")


#: The list that the query uses: what a directory of gambling, pill, advertising, adult and spam sites publishes. It
#: doesn't depend on the pages that are judged, most of its URLs aren't among them.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_PREFIXES, LISTED_ZONES, LISTED_LANGS, LISTED_ENDS, LISTED_NUMBERS = ("", "m.", "blog."), ("com", "net"), ("de", "en", "es", "fr"), ("", ".html", "?page=2"), 10_000


def directory(spark: SparkSession) -> DataFrame:
    """canonical: 4.3 million URLs."""
    hosts = [f"{p}{site}.example.{zone}/{lang}/" for site in LISTED_SITES for p in LISTED_PREFIXES for zone in LISTED_ZONES for lang in LISTED_LANGS]
    rows = spark.range(LISTED_NUMBERS).select("id", F.explode(F.array(*map(F.lit, hosts))).alias("head"))
    return rows.select(F.explode(F.array(*[F.concat("head", "id", F.lit(e)) for e in LISTED_ENDS])).alias("canonical"))


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """The verdict on every url of ``pages`` by the rules, else by the directory; a row a page, null urls are allowed."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), directory(spark))


OP2_SQL = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3), ''), '(?:^|&)(?:utm_[^&]*|ref=[^&]*)', '', 'g'), '^&', '') AS query
  FROM pages),
canon AS (SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '/$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM parts),
lst AS (
  SELECT p || s || '.example.' || z || '/' || l || '/' || n || e AS canonical
  FROM unnest(['', 'm.', 'blog.']) a(p), unnest(['ads-track', 'adult-x', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) b(s), unnest(['com', 'net']) c(z), unnest(['de', 'en', 'es', 'fr']) d(l), range(10000) f(n), unnest(['', '.html', '?page=2']) g(e)),
rules(what, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(what, length(rhost || rpath)) AS what
  FROM canon JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT c.page_id, c.host, c.path, f.rule, coalesce(f.what, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, c.canonical, l.canonical IS NOT NULL AS listed
FROM canon c LEFT JOIN fit f USING (page_id) LEFT JOIN lst l ON c.canonical = l.canonical
"""
