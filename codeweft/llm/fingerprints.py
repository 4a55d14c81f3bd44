"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon is every term whose inverse document frequency ln(N / df) over the whole corpus lies in
a band. A document's distinct lexicon terms are sorted and hashed as a whole and under each of
some random subsets of the lexicon. The subsets have different densities, so that of long and
of short documents some share survives an edit. The fingerprint lists these hashes; the likeness
of two is the part of equal ones among those that aren't empty for both.

The lexicon is bounded: a term in it is in at least N * exp(-idf_high) documents, so it has at most
exp(idf_high) times the mean number of distinct terms of a document, whatever N is. It therefore
goes to the executors whole, as a constant table of hash buckets, and documents are
fingerprinted in place: no term leaves its row but for the counting of document frequencies
(partial sums of 8-byte term hashes).

Defined results: null texts count as empty. A text without lexicon terms is fingerprinted by all its
distinct terms, an empty one by the empty set; empty fingerprints are equal to one another. The
next document is the next in (doc_id, md5 of the text) order, null ids first; after the last comes the
first. Repeated rows follow one another. Other columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: ln(N / df): terms in more than a tenth or less than one in 2000 of the documents are left out.
IDF_BAND = (math.log(10), math.log(2000))
#: (bits, subsets): a level hashes each term to one of 2^bits classes, the first few of which are subsets.
LEVELS = ((2, 2), (3, 3), (4, 4), (5, 4), (6, 4), (7, 4), (8, 3), (9, 2))
EMPTY = "-"


def term_hashes(text: Column) -> Column:
    """Distinct hashed terms of a text."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS)
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def lexicon(docs: DataFrame, idf_band: tuple[float, float] = IDF_BAND, text_col: str = "text") -> DataFrame:
    """term (hash), df: the terms of the band."""
    n = docs.count()
    least, most = max(2, math.ceil(n * math.exp(-idf_band[1]))), n * math.exp(-idf_band[0])
    terms = docs.select(F.explode(term_hashes(F.col(text_col))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= least) & (F.col("df") <= max(most, least)))


def _membership(lex: DataFrame):
    """A function of a term hash column: is it in the lexicon? A constant table of hash buckets (the lexicon is bounded)."""
    terms = sorted(r["term"] for r in lex.select("term").collect())
    size = 1 << max(4, (len(terms) // 2).bit_length())
    buckets: list[list[int]] = [[] for _ in range(size)]
    for t in terms:
        buckets[t & (size - 1)].append(t)
    found = F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<array<bigint>>")  # folded to one literal
    return lambda t: F.array_contains(F.element_at(found, (t.bitwiseAND(F.lit(size - 1)) + 1).cast("int")), t)


def fingerprint_of(terms: Column, levels=LEVELS) -> Column:
    """Codes of a sorted array of term hashes: of all of it, then of each subset."""
    none = F.xxhash64(F.array().cast("array<bigint>"))
    parts, top = [F.array(F.hex(F.xxhash64(terms)))], 64
    for bits, n in levels:
        top -= bits
        of = lambda t, top=top, bits=bits: F.shiftrightunsigned(t, top).bitwiseAND(F.lit((1 << bits) - 1))
        parts.append(_let(F.filter(terms, _test(of, n, False)), _codes(of, n, none)))
    return F.array_join(F.concat(*parts), ",", EMPTY)


def _codes(of, n: int, none: Column):
    return lambda own: F.array(*[F.hex(F.nullif(F.xxhash64(F.filter(own, _test(of, i, True))), none)) for i in range(n)])


def _test(of, n: int, same: bool):
    return (lambda t: of(t) == n) if same else (lambda t: of(t) < n)


def likeness(a: Column, b: Column) -> Column:
    pairs = F.arrays_zip(F.split(a, ",").alias("a"), F.split(b, ",").alias("b"))
    filled = F.filter(pairs, lambda p: (p["a"] != EMPTY) | (p["b"] != EMPTY))
    return F.size(F.filter(filled, lambda p: p["a"] == p["b"])) / F.size(filled)


def followed(rows: DataFrame, columns: list[str], need: Column | None = None, cut: tuple[str, ...] = (), copies_at_once: int = 10_000) -> DataFrame:
    """doc_id, ``columns`` and next_<c>, the value of c in the row that follows in the order of (doc_id, tie).

    ``rows``: doc_id, tie and the columns; rows equal in doc_id and tie are equal in all. Of the columns
    in ``cut`` only the first ``need`` characters (of the row that gets them) are sent.

    Only (doc_id, tie, need) are sorted, in ranges that Spark draws from a sample, so neither an odd
    spread of ids nor a repeated id fills one task; each row is then joined by key with what the row
    after it sends. Copies of a row are one in the sort and joins and are spread out at the end.
    """
    keys = ["doc_id", "tie"]
    need = F.lit(0) if need is None else need
    light = rows.select(*keys, need.cast("int").alias("need")).groupBy(*keys, "need").agg(F.count("*").alias("copies"))
    order = written(light.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "order")
    n, distinct = order.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count("*")).first()
    # The row before the first of a partition is the last of the partition before it that isn't empty. A row a partition.
    part = F.shiftright("at", 33)
    ends, by = order.groupBy(part.alias("part")).agg(F.min("at").alias("first"), F.max("at").alias("last")), Window.orderBy("part")
    ends = ends.select("first", F.coalesce(F.lag("last").over(by), F.max("last").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    placed = order.join(F.broadcast(ends), order["at"] == ends["first"], "left").select(*keys, F.coalesce("before", F.col("at") - 1).alias("prev"))
    goal = order.select(F.col("at").alias("prev"), F.col("doc_id").alias("to_id"), F.col("tie").alias("to_tie"), F.col("need").alias("to_need"), F.col("copies").alias("to_copies"))
    links = written(placed.join(goal, "prev").select(F.col("doc_id").alias("from_id"), F.col("tie").alias("from_tie"), "to_id", "to_tie", "to_need", "to_copies"), "order-links")
    body = rows.select(*keys, *columns)
    if n != distinct:
        body = body.groupBy(*keys).agg(*[F.first(c).alias(c) for c in columns])
    send = [(F.substring(F.col(c), F.lit(1), F.col("to_need")) if c in cut else F.col(c)).alias(f"next_{c}") for c in columns]
    sent = body.join(links, F.expr("doc_id <=> from_id and tie = from_tie")).select("to_id", "to_tie", "to_copies", *send)
    out = body.join(sent, F.expr("doc_id <=> to_id and tie = to_tie")).select("doc_id", *columns, *[f"next_{c}" for c in columns], "to_copies", *(["tie"] if n != distinct else []))
    if n != distinct:
        # The last copy is followed by the next row, the others by a copy of themselves.
        out = written(out, "followed")
        own = [(F.substring(F.col(c), F.lit(1), need.cast("int")) if c in cut else F.col(c)).alias(f"next_{c}") for c in columns]
        runs = F.sequence(F.lit(0).cast("long"), F.expr(f"(to_copies - 2) div {copies_at_once}"))
        more = out.where("to_copies > 1").withColumn("run", F.explode(runs)).repartition("tie", "run")
        more = more.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(copies_at_once).cast("long"), F.col("to_copies") - 1 - F.col("run") * copies_at_once))))
        out = out.unionByName(more.select("doc_id", *columns, *own, "to_copies", "tie"))
    return out.select("doc_id", *columns, *[f"next_{c}" for c in columns])


def fingerprints(docs: DataFrame, idf_band: tuple[float, float] = IDF_BAND, levels=LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (comma-joined hex codes, ``-`` for an empty subset); a row a document."""
    sign = _signer(docs, idf_band, levels, text_col)
    return docs.select(F.col(id_col).alias("doc_id"), sign(F.col(text_col)).alias("fingerprint"))


def _signer(docs: DataFrame, idf_band, levels, text_col):
    inside = _membership(written(lexicon(docs, idf_band, text_col), "lexicon"))

    def sign(text: Column) -> Column:
        filled = lambda every, own: F.sort_array(F.when(F.size(own) > 0, own).otherwise(every))
        return _let(term_hashes(text), lambda every: _let(F.filter(every, inside), lambda own: _let(filled(every, own), lambda t: fingerprint_of(t, levels))))

    return sign


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every text of ``documents`` and of its edited text, whose last quarter is the next document's beginning.

    A row a document, repeated rows and null ids included; a null text is an empty one.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sign = _signer(docs, IDF_BAND, LEVELS, "text")
    n, k = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = docs.select("doc_id", F.md5("text").alias("tie"), "text", sign(F.col("text")).alias("fingerprint"))
    both = followed(rows, ["text", "fingerprint"], need=k, cut=("text",))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), "next_text")
    both = both.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", sign(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return both.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
