"""Near-duplicate documents by HyperMinHash.

1. Each text becomes its set of 64-bit hashes of ``width``-word shingles. Documents with equal sets
   are one: the copy with the smallest id stands for all.
2. The set is compressed to ``REGISTERS`` 16-bit registers, one a bucket: the hash range is split into
   equal buckets, and of the smallest hash value in each, six bits for the number of leading zeros and
   ten of mantissa are stored. Buckets that stay empty, most of them in small sets, take the register
   of a bucket that isn't, by a fixed random order of their own (optimal densification), so sets of
   all sizes agree in a register with the probability of their similarity.
3. Bands of ``ROWS`` registers are hashed; documents that share a band are candidates. At a
   similarity of 0.8 a pair shares none of the 40 bands with probability 5e-6 (none of 51,000 simulated
   pairs of 5 to 3,000 shingles did).
4. A member of a band is first compared with the band's smallest id. Links found so make components;
   then all pairs of a band that are still in different components are compared, large bands in
   blocks. So every candidate pair is either connected already or compared: no link that the bands
   show is lost, and no group is spread into all its pairs.
5. Comparing: Jaccard similarity estimated from the registers, corrected for registers that agree by
   chance, must be within six standard errors of the threshold (those of as many registers as the
   larger set has shingles, if they are fewer); the exact test is then made on full sets, in whole numbers,
   by cells of documents, so that a set isn't sent with every pair.

Defined results: null texts, empty ones and those without words have an empty set, n_shingles 0 and
link with nothing. Texts with fewer words than ``width`` have one shingle, all their words. Rows
that repeat a doc_id count as linked with one another. A row with a null id is never linked: its
component_id is null and kept is true. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, lean, small_batches, table, written
from .components import components

BANDS, ROWS = 40, 6
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Buckets that an empty one asks in turn before it takes the next one that isn't empty.
DONORS = 24
#: Ids that a broadcast may hold (some 16 MB).
BROADCAST_IDS = 500_000
BLOCK, BLOCK_ITEMS = 512, 1 << 17
#: Groups of at most so many rows are compared together, so many pairs at once.
SMALL_GROUP, PAIRS_AT_ONCE = 64, 4096
DOCS_AT_ONCE = 64

_U = np.uint64
_rng = np.random.default_rng(20240229)
_DONORS = _rng.integers(0, REGISTERS, size=(REGISTERS, DONORS))
_WIDTH = (1 << 64) // REGISTERS + 1
_STARTS = np.arange(REGISTERS, dtype=np.uint64) * _U(_WIDTH)


class WordHashes:
    """64-bit hashes of words. There is no memo: a look-up takes longer than the hash."""

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _shingles(h: np.ndarray, width: int) -> np.ndarray:
    """Of hashes of words in order: one of each run of ``width``."""
    n = len(h) - width + 1
    code = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        code = _mixed(code * _U(0x9E3779B97F4A7C15) + h[k : k + n])
    return code


def shingle_sets(texts: list[str | None], width: int, hashes: WordHashes) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; those of all texts are made at once."""
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]  # bytes: A-Z alone, and ASCII white space
    h = hashes.of(list(chain.from_iterable(words)))
    code = _shingles(h, width) if len(h) >= width else h[:0]
    out, at = [], 0
    for w in words:
        n = len(w)
        if n >= width:
            out.append(np.unique(code[at : at + n - width + 1]))
        else:
            out.append(_shingles(h[at : at + n], n) if n else h[:0])
        at += n
    return out


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    return shingle_sets([text], width, hashes)[0]


def registers_of(low: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 32-bit values."""
    low = low.astype(np.uint64)
    bits = np.frexp(low.astype(np.float64))[1].astype(np.uint64)
    zeros = _U(32) - bits
    mantissa = ((low << (zeros + _U(1))) & _U(0xFFFFFFFF)) >> _U(32 - MANTISSA)
    return ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a sorted array of distinct hashes, at least one."""
    at = np.searchsorted(hashes, _STARTS)
    full = at < np.append(at[1:], len(hashes))
    first = hashes[np.minimum(at, len(hashes) - 1)]
    low = np.minimum((first - _STARTS) >> _U(24), _U(0xFFFFFFFF))
    out = registers_of(low)
    if not full.all():
        empty = np.flatnonzero(~full)
        donors = _DONORS[empty]
        ready = full[donors]
        from_ = donors[np.arange(len(empty)), ready.argmax(axis=1)]
        late = ~ready.any(axis=1)
        if late.any():
            there = np.flatnonzero(full)
            from_[late] = there[np.searchsorted(there, empty[late]) % len(there)]
        out[empty] = out[from_]
    return out


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of rows of registers and set sizes: the share of equal registers, less the chance agreement of
    different minima (cells of relative width 2^-10: 0.72 * 2^-10 * nm / (n + m)^2)."""
    share = (a == b).sum(axis=-1) / REGISTERS
    n, m = n.astype(np.float64), m.astype(np.float64)
    chance = 0.72 * 2.0**-MANTISSA * n * m / (n + m) ** 2
    return np.clip((share - chance) / (1 - chance), 0, 1)


def least_estimate(threshold: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What the estimate of sets of these sizes must reach."""
    return threshold - 6 * (threshold * (1 - threshold) / np.minimum(np.maximum(n, m), REGISTERS)) ** 0.5


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, h1, h2 (hashes of the set), registers (null for an empty set)."""

    def run(batches):
        hashes = WordHashes()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part, out = batch.slice(k, DOCS_AT_ONCE), []
                for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1).to_pylist(), width, hashes), strict=True):
                    n = len(s)
                    h1 = int(s.sum().view(np.int64)) if n else 0
                    h2 = int(_mixed(s * _U(0xD6E8FEB86659FD93) + _U(1)).sum().view(np.int64)) if n else 0
                    out.append((i, n, h1, h2, sketch(s).tobytes() if n else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n", "h1", "h2", "registers"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, n long, h1 long, h2 long, registers binary")


def _bands(reps: DataFrame) -> DataFrame:
    """doc_id, band key: a row a band."""
    keys = [F.xxhash64(F.lit(b), F.substring("registers", 2 * ROWS * b + 1, 2 * ROWS)) for b in range(BANDS)]
    return reps.select("doc_id", F.explode(F.array(*keys)).alias("band"))


def _registers(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint16).reshape(-1, REGISTERS)


def _estimated(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that may reach the threshold by size and by the estimate."""
    own = lambda x: reps.select(F.col("doc_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "registers")])
    both = pairs.join(own("a"), "a").join(own("b"), "b").where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * threshold - 1e-9)

    def run(frames):
        for pdf in frames:
            n, m = pdf["n_a"].to_numpy(), pdf["n_b"].to_numpy()
            keep = estimated_jaccard(_registers(pdf["registers_a"]), _registers(pdf["registers_b"]), n, m) >= least_estimate(threshold, n, m)
            yield pdf.loc[keep, ["a", "b"]]

    return both.mapInPandas(lean(run), "a long, b long").distinct()


def _group_starts(rows: pa.RecordBatch) -> np.ndarray:
    """Where groups of equal keys begin; at least one row. The keys are the columns band (if there is one), i and j."""
    keys = [rows.column(k).to_numpy(zero_copy_only=False) for k in ("band", "i", "j") if k in rows.schema.names]
    return np.append(0, np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1)


def _whole_groups(batches):
    """The same rows, sorted by group, in batches that end where a group does."""
    held: list[pa.RecordBatch] = []  # the last group so far, which the next batch may go on with
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(_group_starts(batch)[-1])
        if cut:
            yield pa.concat_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and len(_group_starts(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]))) > 1:
            yield pa.concat_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.concat_batches(held)


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs whose full sets meet 100 * intersection >= percent * union.

    Pairs grow with the square of a family of similar texts, so sets don't go with each pair: documents are put into
    cells, those with the same smallest partner together, and a set goes once to each two cells between which it has pairs.
    """
    pairs = written(pairs, "pairs")
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("need"), F.col("b").alias("other")), F.struct(F.col("b").alias("need"), F.col("a").alias("other")))).alias("e")).select("e.*")
    need = written(ends.groupBy("need").agg(F.least(F.min("other"), F.col("need")).alias("near")), "pair-ids")
    few = need.count() <= BROADCAST_IDS
    ids = need.select("need")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("need"), "left_semi")

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for k in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(k, DOCS_AT_ONCE)
                sets = [s.view(np.int64) for s in shingle_sets(part.column(1).to_pylist(), width, hashes)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "items"])

    sets = written(texts.mapInArrow(lean(run), "doc_id long, items array<long>"), "pair-sets")
    placed = written(_placed(pairs, need, sets), "placed-pairs")
    there = placed.select("i", "j", F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(sets, "doc_id")
    rows = there.select("i", "j", F.col("doc_id").alias("a"), F.lit(None).cast("long").alias("b"), "items").unionByName(placed.select("i", "j", "a", "b", F.lit(None).cast("array<long>").alias("items")))

    def check(batches):
        for part in _whole_groups(batches):
            yield _linked(part, percent)

    return written(rows.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(lean(check), "a long, b long"), "links")


def _placed(pairs: DataFrame, need: DataFrame, sets: DataFrame) -> DataFrame:
    """i, j, a, b: the pairs with the cells of their documents, the lesser first. A cell has some BLOCK documents and BLOCK_ITEMS hashes at most."""
    nodes = need.join(sets.groupBy(F.col("doc_id").alias("need")).agg(F.sum(F.size("items")).alias("n")), "need")
    chunks = nodes.groupBy("near").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_ITEMS))).alias("chunks"))
    cells = written(nodes.join(chunks, "near").select("need", F.xxhash64("near", F.pmod(F.xxhash64("need"), F.col("chunks"))).alias("cell")), "pair-cells")
    own = lambda x: cells.select(F.col("need").alias(x), F.col("cell").alias(f"cell_{x}"))
    both = pairs.join(own("a"), "a").join(own("b"), "b")
    return both.select(F.least("cell_a", "cell_b").alias("i"), F.greatest("cell_a", "cell_b").alias("j"), "a", "b")


def _linked(rows: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """a, b: the pairs of whole groups (rows with b) whose sets (rows with items) are similar enough."""
    starts, found = _group_starts(rows), []
    for start, end in zip(starts.tolist(), [*starts[1:].tolist(), rows.num_rows], strict=True):
        group = rows.slice(start, end - start)
        is_pair = group.column(3).is_valid()
        sets, pairs = group.filter(pc.invert(is_pair)), group.filter(is_pair)
        a, b = pairs.column(2).to_numpy(), pairs.column(3).to_numpy()
        items = sets.column(4).flatten().to_numpy()
        sizes = sets.column(4).value_lengths().to_numpy()
        order = np.argsort(sets.column(2).to_numpy(), kind="stable")
        ids = sets.column(2).to_numpy()[order]
        p, x = _rows_of(a, ids)
        q, y = _rows_of(b[p], ids)
        p, x, y = p[q], order[x[q]], order[y]
        common = _common(items, sizes, x, y)
        total = sizes[x].astype(np.int64) + sizes[y]
        good = np.unique(p[(total > 0) & (common * 100 >= (total - common) * percent)])
        found.append(np.stack([a[good], b[good]], axis=1))
    links = np.concatenate(found)
    return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], names=["a", "b"])


def _rows_of(wanted: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each id all places among sorted ids that may repeat: which of ``wanted``, and the place."""
    first = np.searchsorted(ids, wanted, "left")
    n = np.searchsorted(ids, wanted, "right") - first
    which = np.repeat(np.arange(len(wanted)), n)
    return which, np.arange(len(which)) + np.repeat(first - (np.cumsum(n) - n), n)


def _common(items: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many items sets x and y share, pair by pair, from bits of the items that several sets have. Sets stand one after the other in ``items``."""
    _, code, n = np.unique(items, return_inverse=True, return_counts=True)
    shared = n > 1
    number = np.cumsum(shared) - 1
    owner, kept = np.repeat(np.arange(len(sizes)), sizes), shared[code]
    owner, bit = owner[kept], number[code[kept]]
    words = int(shared.sum()) // 64 + 1
    bits = np.zeros((len(sizes), words), dtype=np.uint64)
    np.bitwise_or.at(bits, (owner, bit // 64), _U(1) << (bit % 64).astype(np.uint64))
    step = max(1, (1 << 18) // words)
    return np.concatenate([np.zeros(0, dtype=np.int64), *(np.bitwise_count(bits[x[k : k + step]] & bits[y[k : k + step]]).sum(axis=1, dtype=np.int64) for k in range(0, len(x), step))])


def _cross_pairs(members: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Pairs within a band whose components differ and whose estimates pass. ``members``: band, doc_id, label."""
    split = members.groupBy("band").agg(F.count("*").alias("size"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    chunks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    rows = members.join(split.select("band", chunks.alias("chunks")), "band").withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))
    to = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: F.struct(F.least(k, F.col("chunk")).alias("i"), F.greatest(k, F.col("chunk")).alias("j")))
    rows = rows.withColumn("to", F.explode(to)).select("band", "to.i", "to.j", "chunk", "doc_id", "label")
    rows = rows.join(reps.select("doc_id", "n", "registers"), "doc_id").select("band", "i", "j", "chunk", "doc_id", "label", "n", "registers")

    def run(batches):
        for part in _whole_groups(batches):
            yield _close_pairs(part, threshold)

    # Most groups are a few rows: many go through Python at once.
    return rows.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j").mapInArrow(lean(run), "a long, b long").distinct()


def _pairs_within(starts: np.ndarray, sizes: np.ndarray):
    """All pairs of rows within groups, some at a time: of small groups those of one size together, of large ones a row with those after it."""
    for s in np.unique(sizes).tolist():
        own = starts[sizes == s]
        if s <= SMALL_GROUP:
            i, j = np.triu_indices(s, 1)
            step = max(1, PAIRS_AT_ONCE // max(1, len(i)))
            for k in range(0, len(own), step):
                base = own[k : k + step, None]
                yield (base + i).ravel(), (base + j).ravel()
        else:
            for start in own.tolist():
                for k in range(start, start + s - 1):
                    yield np.full(start + s - 1 - k, k), np.arange(k + 1, start + s)


def _close_pairs(rows: pa.RecordBatch, threshold: float) -> pa.RecordBatch:
    """a, b: pairs of whole groups whose labels differ and whose estimates pass."""
    i, j, chunk, ids, label, n = (rows.column(k).to_numpy(zero_copy_only=False) for k in range(1, 7))
    regs, apart = _registers(rows.column(7).to_pylist()), i != j
    starts = _group_starts(rows)
    found = [np.zeros((0, 2), dtype=np.int64)]
    for a, b in _pairs_within(starts, np.diff(np.append(starts, rows.num_rows))):
        own = (ids[a] != ids[b]) & (label[a] != label[b]) & ~(apart[a] & (chunk[a] == chunk[b]))
        own &= np.minimum(n[a], n[b]) >= np.maximum(n[a], n[b]) * threshold - 1e-9
        a, b = a[own], b[own]
        if len(a):
            close = estimated_jaccard(regs[a], regs[b], n[a], n[b]) >= least_estimate(threshold, n[a], n[b])
            found.append(np.sort(np.stack([ids[a[close]], ids[b[close]]], axis=1), axis=1))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", one_task: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; a row a document."""
    threshold = percent / 100
    small_batches(docs.sparkSession)
    rows = written(sketches(docs, width, id_col, text_col), "sketches")
    real = rows.where("n > 0 and doc_id is not null")
    reps = written(real.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "distinct-sets")
    total = rows.count()
    own = written(
        real.join(reps.select("h1", "h2", "n", F.col("rep").alias("doc_id")), ["h1", "h2", "n", "doc_id"], "left_semi").dropDuplicates(["h1", "h2", "n", "doc_id"]).select("doc_id", "n", "registers"), "distinct-sketches"
    )
    bands = _bands(own)
    shared = bands.groupBy("band").agg(F.count("*").alias("size"), F.min("doc_id").alias("center")).where("size > 1")
    shared = written(shared, "shared-bands")
    members = written(hot_join(bands, shared, ["band"], "size", total), "band-members")
    first = members.where("doc_id <> center").groupBy("doc_id").agg(F.min("center").alias("a")).select("a", F.col("doc_id").alias("b"))
    links = _verified(_estimated(first, own, threshold), docs, width, percent, id_col, text_col)
    again = real.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    repeated = real.join(again, "doc_id").join(reps, ["h1", "h2", "n"]).select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))  # ids given to several rows
    links = links.unionByName(repeated)
    label = components(links, one_task).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label")
    marked = members.select("band", "doc_id").join(label, "doc_id", "left").select("band", "doc_id", F.coalesce("label", "doc_id").alias("label"))
    more = _verified(_cross_pairs(marked, own, threshold), docs, width, percent, id_col, text_col)
    final = components(links.unionByName(more), one_task).select(F.col("node").alias("rep"), "component")
    named = reps.join(final, "rep", "left").select("h1", "h2", "n", "copies", F.coalesce("component", "rep").alias("component"))
    named = written(named, "set-components")
    linked = hot_join(real.select("doc_id", "n", "h1", "h2"), named, ["h1", "h2", "n"], "copies", total)
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    out = linked.select("doc_id", "n", "component").unionByName(alone)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def without_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates; all columns. Of rows that repeat an id one stays."""
    found = written(near_duplicates(docs, width, percent, id_col, text_col), "near-duplicates")
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    gone = written(gone, "dropped-ids")
    few = gone.count() <= BROADCAST_IDS
    left = docs.join(F.broadcast(gone) if few else gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
    kept = found.where("kept and doc_id is not null")
    if kept.count() != kept.select("doc_id").distinct().count():
        named = left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col])
        left = named.unionByName(left.where(F.col(id_col).isNull()))
    return left


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` by sets of two-word shingles; a row a document, see above for nulls and repeats."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)


#: All pairs that share a shingle, on full sets; components by recursion.
OP4_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS g FROM w WHERE len(ws) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS reached FROM (SELECT DISTINCT a FROM e) UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT doc_id, min(reached) AS component FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component, d.doc_id) AS component_id, d.doc_id = coalesce(c.component, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
