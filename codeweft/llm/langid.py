"""Language identification with language-bitmask n-gram filters.

Training counts byte n-grams (lower-cased text, anything but letters as one space, 3 to 5 bytes) by
language in labelled documents. An n-gram belongs to every language in which it is at least
``TYPICAL`` times as frequent as where it is most frequent. The languages' sets become Bloom filters
that share hash functions and are stored bit-sliced: the row of a hash value has one bit for each
language, so the AND of an n-gram's rows is the bitmask of all languages that contain it. Beyond 64
languages a bitmask has several words, which are read one after the other. A text's
per-language counts of hits, with each filter's expected false positives taken off, decide.

Training takes at most about ``SAMPLE_PER_LANG`` documents of each language, drawn by a hash of
their id (a documented bound; the model grows with the number of languages, not with the corpus).
All languages are learned, however many. Prediction reads every text whole.

Defined results: ``und``, score 0, if the text is null or has no letter, or if nothing was learned.
A text with letters of which no n-gram is known gets the language with most training documents,
score 0. Ties go to the language with more training documents, then to the first by name. Repeated
rows are predicted each. Rows with a null id or language aren't learned from.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import lean, small_batches, table

SIZES = (3, 4, 5)
SAMPLE_PER_LANG = 2000
TYPICAL = 0.25
#: An n-gram must be seen once for each so many documents in the sample, but no more than MOST_COUNT times.
DOCS_PER_COUNT = 50
MOST_COUNT = 8
HASHES = 3
#: Languages in a word of a bitmask.
WORD_BITS = 64
BITS_PER_GRAM = 12
UNKNOWN = "und"
DOCS_AT_ONCE = 128
#: Bytes that are hashed at once, and hashes that training gathers before it counts them.
PIECE = 1 << 16
COUNTED_HASHES = 1 << 19

_KEPT = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_SPACES = re.compile(b"  +")
_EASY = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return _EASY.search(text) is not None or any(map(str.isalpha, text))


def letters_of(text: str) -> bytes:
    return b" " + _SPACES.sub(b" ", text.lower().encode("utf-8", "replace").translate(_KEPT)).strip() + b" "


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all n-grams of an array of bytes; as many for each size as bytes (the last few are of what follows)."""
    wide = np.concatenate([data, np.zeros(max(SIZES), dtype=np.uint8)]).astype(np.uint64)
    n, code, found = len(data), np.zeros(len(data), dtype=np.uint64), []
    for k in range(max(SIZES)):
        code = code | (wide[k : k + n] << np.uint64(8 * k))
        if k + 1 in SIZES:
            h = (code + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            found.append(h ^ (h >> np.uint64(29)))
    return np.stack(found)


@dataclass
class Model:
    languages: list[str]
    #: Words of a bitmask x rows of the bit-sliced filters; a power of two of rows.
    rows: np.ndarray
    #: Each filter's rate of false positives.
    false: np.ndarray

    def masks(self, hashes: np.ndarray, word: int) -> np.ndarray:
        """Of each hash, a word of the bitmask of languages whose filters hold it."""
        rows, out = self.rows[word], None
        last = np.uint64(len(rows) - 1)
        for k in range(HASHES):
            found = rows[((hashes >> np.uint64(21 * k)) & last).astype(np.int64)]
            out = found if out is None else out & found
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """texts x languages: the share of n-grams that a language holds, less its false positives.

        Texts are read in pieces that overlap by the longest n-gram less one, so long ones take no more
        memory; an n-gram counts where it begins.
        """
        hits = np.zeros((len(texts), len(self.languages)))
        many = np.array([max(sum(max(len(t) - n + 1, 0) for n in SIZES), 1) for t in texts])
        held: list[tuple[int, bytes]] = []
        size = 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), PIECE):
                held.append((i, t[a : a + PIECE + max(SIZES) - 1]))
                size += len(held[-1][1])
                if size >= PIECE:
                    self._count(held, hits)
                    held, size = [], 0
        self._count(held, hits)
        return np.clip((hits / many[:, None] - self.false) / (1 - self.false), 0, 1)

    def _count(self, pieces: list[tuple[int, bytes]], hits: np.ndarray) -> None:
        if not pieces:
            return
        data = np.frombuffer(b"".join(p for _, p in pieces), dtype=np.uint8)
        sizes = np.array([len(p) for _, p in pieces])
        starts = np.cumsum(sizes) - sizes
        hashes = gram_hashes(data)
        place = np.arange(len(data)) - np.repeat(starts, sizes)
        left = np.repeat(sizes, sizes) - place
        owner = np.array([i for i, _ in pieces])
        for word in range(len(self.rows)):
            masks, first = self.masks(hashes, word), word * WORD_BITS
            for i, n in enumerate(SIZES):
                own = np.where((left >= n) & (place < PIECE), masks[i], 0)
                for j in range(min(WORD_BITS, len(self.languages) - first)):
                    found = np.add.reduceat((own >> self.rows.dtype.type(j)) & self.rows.dtype.type(1), starts, dtype=np.int64)
                    np.add.at(hits[:, first + j], owner, found)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        if not self.languages:
            return out
        real = [i for i, t in enumerate(texts) if t and has_letter(t)]
        for a in range(0, len(real), DOCS_AT_ONCE):
            some = real[a : a + DOCS_AT_ONCE]
            s = self.scores([letters_of(texts[i]) for i in some])
            best = s.argmax(axis=1)
            for i, b, row in zip(some, best.tolist(), s, strict=True):
                total = float(row.sum())
                out[i] = (self.languages[b], float(row[b]) / total if total > 0 else 0.0)
        return out


def build_model(grams: list[tuple[int, int, int]], languages: list[str]) -> Model:
    """``grams``: (language's number, hash, count). Languages stand in order of preference at ties."""
    if not languages:
        return Model([], np.zeros((1, 1), dtype=np.uint8), np.zeros(0))
    kind = next((t for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), np.uint64)
    lang = np.array([g[0] for g in grams], dtype=np.int64)
    h = np.array([g[1] for g in grams], dtype=np.int64).view(np.uint64)
    n = np.array([g[2] for g in grams], dtype=np.float64)
    total = np.maximum(np.bincount(lang, weights=n, minlength=len(languages)), 1)
    rate = n / total[lang]
    keys, at = np.unique(h, return_inverse=True)
    most = np.zeros(len(keys))
    np.maximum.at(most, at, rate)
    kept = rate >= TYPICAL * most[at]
    lang, h = lang[kept], h[kept]
    per = int(np.bincount(lang, minlength=len(languages)).max()) if len(lang) else 1
    size = 1 << max(10, (per * BITS_PER_GRAM).bit_length())
    rows = np.zeros((-(-len(languages) // WORD_BITS), size), dtype=kind)
    bits = np.left_shift(np.ones(len(lang), dtype=kind), (lang % WORD_BITS).astype(kind))
    for k in range(HASHES):
        np.bitwise_or.at(rows, (lang // WORD_BITS, ((h >> np.uint64(21 * k)) & np.uint64(size - 1)).astype(np.int64)), bits)
    fill = np.array([np.count_nonzero(rows[j // WORD_BITS] & kind(1 << j % WORD_BITS)) / size for j in range(len(languages))])
    return Model(languages, rows, fill**HASHES)


def train(labelled: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """``labelled``: id, text, lang."""
    labelled = labelled.where("id is not null and lang is not null and text is not null")
    known = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in known]
    small_batches(labelled.sparkSession)
    if not languages:
        return build_model([], [])
    # A row a language: a join, so that many of them make no long expression.
    spark = labelled.sparkSession
    numbers = spark.createDataFrame([(r["lang"], k, min(1.0, sample_per_lang / r["count"])) for k, r in enumerate(known)], "lang string, k int, rate double")
    labelled = labelled.join(F.broadcast(numbers), "lang")  # a row a language
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1_000_000)) < F.col("rate") * 1_000_000
    need = {k: max(1, min(MOST_COUNT, int(min(r["count"], sample_per_lang) // DOCS_PER_COUNT))) for k, r in enumerate(known)}

    def count(batches):
        found: dict[int, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for k, text in zip(batch.column(0), batch.column(1), strict=True):
                letters = letters_of(text.as_py())
                for a in range(0, len(letters), PIECE):
                    data = np.frombuffer(letters[a : a + PIECE + max(SIZES) - 1], dtype=np.uint8)
                    hashes = gram_hashes(data)
                    own = np.concatenate([hashes[i, : min(PIECE, max(0, len(data) - n + 1))] for i, n in enumerate(SIZES)])
                    found.setdefault(k.as_py(), []).append(own)
                    held += len(own)
                    if held >= COUNTED_HASHES:
                        yield from counted(found)
                        found, held = {}, 0
        yield from counted(found)

    def counted(found):
        for k, parts in found.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, dtype=np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], names=["k", "h", "n"])

    grams = labelled.where(draw).select("k", "text").mapInArrow(lean(count), "k int, h long, n long")
    least = spark.createDataFrame(list(need.items()), "k int, least int")
    grams = grams.groupBy("k", "h").agg(F.sum("n").alias("n")).join(F.broadcast(least), "k").where("n >= least").drop("least")
    pdf = grams.toPandas()  # bounded by the sample
    return build_model(list(zip(pdf["k"], pdf["h"], pdf["n"], strict=True)), languages)


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` and, under ``names``, the predicted language and its score."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inside = text_col in keep
    rows = docs.select(*keep) if inside else docs.select(*keep, text_col)
    at = keep.index(text_col) if inside else len(keep)
    schema = StructType([*rows.schema.fields[: len(keep)], StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def run(batches):
        own = shared.value
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(i, DOCS_AT_ONCE)
                found = own.predict(part.column(at).to_pylist())
                more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), *more], names=[*keep, *names])

    return rows.mapInArrow(lean(run), schema)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from those not held out; a row a document, ``und`` for null texts and those without a letter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang"))
    return identify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
