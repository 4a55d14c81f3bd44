"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The corpus's most frequent words (counted over all of it; ``lexicon_words`` of them, a documented
bound) are compiled with their id sequences into a minimal acyclic automaton: states with equal
futures are one, so suffixes are shared, and each transition carries a number; the numbers on a
word's path add up to its place among the words, under which its ids stand. The file is written to
the shared folder, sent to each executor by Spark and memory-mapped there: all workers of a machine
share its pages. Words that the automaton lacks are merged by the vocabulary's ranks, exactly.
So the lexicon decides how fast a text is encoded, never how.

Texts go through the vocabulary's own normalisation: NFC, lower case, and a split into letters,
single digits and runs of other characters. Texts of characters below U+0180 are split here; for
others, whose tables depend on the Unicode version, the tokenizer's own normaliser and splitter are
called. Special tokens in a text are special tokens.

Defined results: a null text is an empty one: no ids, decoded to the empty text. Texts of any length
are encoded whole. Repeated rows are encoded each. Other columns are ignored (``encode_documents``
keeps those it is told to).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections import Counter
from functools import cached_property, lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import CACHES, lean, shared_path, small_batches, table, written

LEXICON_WORDS = 100_000
END = "</w>"
#: Entries of a worker's memo of words; it is emptied when full.
MEMO_WORDS = 200_000
DOCS_AT_ONCE = 200
#: Words of at most so many bytes are merged side by side, so many at once.
MOST_SIDE, WORDS_AT_ONCE = 24, 4096
NO_RANK = np.int32(2**31 - 1)
#: Words that a task counts before it hands them on.
COUNTED_WORDS = 200_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [chars[b] for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary file: exact splitting, merging and decoding."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.ids: dict[str, int] = dict(spec["model"]["vocab"])
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] or []}
        self.tokens |= {i: t for t, i in self.special.items()}
        self._shown = [self.tokens.get(i, "").encode("utf-8") for i in range(max(self.tokens, default=-1) + 1)]
        self.ranks = {tuple(m): k for k, m in enumerate(spec["model"]["merges"])}
        self.alphabet = byte_alphabet()
        own = Tokenizer.from_file(path)
        self._normalise, self._split = own.normalizer.normalize_str, own.pre_tokenizer.pre_tokenize_str
        self._undo = {c: b for b, c in enumerate(self.alphabet)}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        import unicodedata

        low = [chr(c) for c in range(0x180)]
        kind = lambda k: "".join(re.escape(c) for c in low if unicodedata.category(c)[0] == k)
        space = "\t-\r \x85\xa0"
        letters, digits = kind("L"), kind("N")
        self._simple = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")
        self._beyond = re.compile("[^\0-ſ]")

    def parts(self, text: str) -> list[str]:
        """Words and special tokens of a text in order."""
        if self._cut and "<|" in text:
            found: list[str] = []
            for k, piece in enumerate(self._cut.split(text)):
                found.extend([piece] if k % 2 else self._words(piece))
            return found
        return self._words(text)

    def _words(self, text: str) -> list[str]:
        if self._beyond.search(text) is None:
            return self._simple.findall(text.lower())
        return [bytes(self._undo[c] for c in w).decode("utf-8") for w, _ in self._split(self._normalise(text))]

    def merge(self, word: str) -> list[int]:
        """The ids of one word by its merges: the lowest rank first, the leftmost of equal ones."""
        if word in self.special:
            return [self.special[word]]
        s = [self.alphabet[b] for b in word.encode("utf-8")]
        s[-1] += END
        ranks = self.ranks
        if len(s) > 24:
            return self._merge_long(s)
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                r = ranks.get((s[i], s[i + 1]))
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return [self.ids[x] for x in s]

    def _merge_long(self, s: list[str]) -> list[int]:
        """The same with a heap of pairs and a linked list, for words of any length."""
        n, ranks = len(s), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        gone = [False] * n
        heap = [(r, i, s[i], s[i + 1]) for i in range(n - 1) if (r := ranks.get((s[i], s[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or s[i] != a or s[j] != b:
                continue
            s[i], gone[j], after[i] = a + b, True, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((s[i], s[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[after[i]]))
            if before[i] >= 0 and (r := ranks.get((s[before[i]], s[i]))) is not None:
                heapq.heappush(heap, (r, before[i], s[before[i]], s[i]))
        return [self.ids[x] for i, x in enumerate(s) if not gone[i]]

    def merge_many(self, words: list[str]) -> list[bytes]:
        """The ids of each word as ``merge`` has them, little-endian unsigned 32-bit; short words take their merges side by side."""
        found: list[bytes] = [b""] * len(words)
        data = [w.encode("utf-8") for w in words]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        side = sizes <= MOST_SIDE
        if self.special:
            side &= ~np.fromiter(map(self.special.__contains__, words), dtype=bool, count=len(words))
        for i in np.flatnonzero(~side).tolist():
            found[i] = np.array(self.merge(words[i]), dtype="<u4").tobytes()
        short = np.flatnonzero(side)
        short = short[np.argsort(sizes[short], kind="stable")]
        for k in range(0, len(short), WORDS_AT_ONCE):
            some = short[k : k + WORDS_AT_ONCE]
            for i, ids in zip(some.tolist(), self.merges.ids([data[i] for i in some.tolist()], sizes[some]), strict=True):
                found[i] = ids
        return found

    @cached_property
    def merges(self) -> Merges:
        return Merges(self.alphabet, self.ranks, self.ids)

    def decode(self, ids) -> str:
        return self.decode_bytes(ids).decode("utf-8")

    def decode_bytes(self, ids) -> bytes:
        """The decoded text in UTF-8."""
        return b" ".join(map(self._shown.__getitem__, ids))


class Merges:
    """A vocabulary's merges as arrays: symbols are numbers, first those of bytes, then those of bytes that end a word."""

    def __init__(self, alphabet: list[str], ranks: dict[tuple[str, str], int], ids: dict[str, int]) -> None:
        number = {c: k for k, c in enumerate([*alphabet, *(c + END for c in alphabet)])}
        left, right, made = (np.array([number.setdefault(x, len(number)) for x in side], dtype=np.int64) for side in ([a for a, _ in ranks], [b for _, b in ranks], [a + b for a, b in ranks]))
        #: What stands after a word's end; no pair holds it.
        self.pad = len(number)
        self.id_of = np.array([ids.get(x, -1) for x in [*number, ""]], dtype=np.int64)
        rank = np.fromiter(ranks.values(), dtype=np.int64, count=len(ranks))
        order = np.argsort(left * (self.pad + 1) + right)
        self.keys, self.rank = (left * (self.pad + 1) + right)[order], rank[order].astype(np.int32)
        self.made = np.zeros(int(rank.max(initial=-1)) + 1, dtype=np.int32)
        self.made[rank] = made

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of symbols; NO_RANK for those that don't merge."""
        key = a.astype(np.int64) * (self.pad + 1) + b
        if not len(self.keys):
            return np.full(key.shape, NO_RANK, dtype=np.int32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], NO_RANK)

    def ids(self, words: list[bytes], sizes: np.ndarray) -> list[bytes]:
        """Of words of at least a byte. In each round every word takes its merge of the lowest rank, the leftmost of equal ones."""
        wide = int(sizes.max(initial=1))
        rows = np.arange(len(words))
        s = np.full((len(words), wide), self.pad, dtype=np.int32)
        s[np.arange(wide) < sizes[:, None]] = np.frombuffer(b"".join(words), dtype=np.uint8)
        s[rows, sizes - 1] += 256
        found: list[bytes] = [b""] * len(words)
        rank = self.ranks(s[:, :-1], s[:, 1:])
        while True:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(s), dtype=np.int64)
            least = rank[np.arange(len(s)), at] if rank.shape[1] else np.full(len(s), NO_RANK)
            over = least == NO_RANK
            if over.any():
                self._put(s[over], rows[over], found)
                s, rank, rows, at, least = (x[~over] for x in (s, rank, rows, at, least))
            if not len(rows):
                return found
            here = np.arange(len(rows))
            after = np.arange(s.shape[1] - 1)
            s = np.take_along_axis(s, after + (after > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, after[:-1] + (after[:-1] > at[:, None]), axis=1)
            s[here, at] = made = self.made[least]
            some = np.flatnonzero(at > 0)
            rank[some, at[some] - 1] = self.ranks(s[some, at[some] - 1], made[some])
            some = np.flatnonzero(at < rank.shape[1])
            rank[some, at[some]] = self.ranks(made[some], s[some, at[some] + 1])

    def _put(self, s: np.ndarray, rows: np.ndarray, found: list[bytes]) -> None:
        there = s != self.pad
        ids = self.id_of[s[there]]
        if (ids < 0).any():
            raise KeyError("the vocabulary lacks a symbol that its merges make, or a byte")
        flat, ends = ids.astype("<u4").tobytes(), np.cumsum(there.sum(axis=1)) * 4
        for i, a, b in zip(rows.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            found[i] = flat[a:b]


def compile_lexicon(entries: dict[bytes, list[int]]) -> np.ndarray:
    """The automaton as one array of int64: sizes, then transitions (state * 256 + byte, sorted),
    their targets and numbers, finality of states, and the ids of the words in order."""
    words = sorted(w for w in entries if w)
    finals: list[bool] = []
    counts: list[int] = []
    arcs: list[tuple[tuple[int, int], ...]] = []
    known: dict[tuple, int] = {}

    def frozen(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in known:
            known[key] = len(finals)
            finals.append(node[0])
            arcs.append(key[1])
            counts.append(int(node[0]) + sum(counts[t] for _, t in key[1]))
        return known[key]

    path: list[list] = [[False, []]]
    last = b""

    def close(upto: int) -> None:
        while len(path) - 1 > upto:
            state = frozen(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    for w in words:
        k = 0
        while k < len(last) and k < len(w) and last[k] == w[k]:
            k += 1
        close(k)
        path.extend([False, []] for _ in range(len(w) - k))
        path[-1][0] = True
        last = w
    close(0)
    root = frozen(path[0])
    keys, targets, numbers = [], [], []
    for state, out in enumerate(arcs):
        number = int(finals[state])
        for byte, target in out:
            keys.append(state * 256 + byte)
            targets.append(target)
            numbers.append(number)
            number += counts[target]
    ids = [entries[w] for w in words]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])]) if ids else np.zeros(1)
    flat = [i for x in ids for i in x]
    return np.concatenate([np.asarray(x, dtype=np.int64) for x in ([root, len(keys), len(finals), len(words), len(flat)], keys, targets, numbers, finals, starts, flat)])


class Lexicon:
    """Look-up of many words at once in a compiled automaton."""

    def __init__(self, blob: np.ndarray) -> None:
        self.root, n, states, words, flat = (int(x) for x in blob[:5])
        cuts = np.cumsum([5, n, n, n, states, words + 1, flat])
        self.keys, self.targets, self.numbers, self.finals, self.starts, self.ids = (blob[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))
        self.states, self.words = states, words

    def find(self, words: list[bytes]) -> list[list[int] | None]:
        """The ids of each word, None for a word that the lexicon lacks."""
        return [self.ids[self.starts[p] : self.starts[p + 1]].tolist() if p >= 0 else None for p in self.places(words).tolist()]

    def places(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that the lexicon lacks."""
        if not words or not len(self.keys):
            return np.full(len(words), -1, dtype=np.int64)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        starts = np.cumsum(sizes) - sizes
        letters = np.frombuffer(b"".join(words), dtype=np.uint8)
        alive = np.arange(len(words))
        state = np.full(len(words), self.root, dtype=np.int64)
        number = np.zeros(len(words), dtype=np.int64)
        place = np.full(len(words), -1, dtype=np.int64)
        depth = 0
        while True:
            over = sizes[alive] == depth
            done = alive[over]
            done = done[self.finals[state[done]] != 0]
            place[done] = number[done]
            alive = alive[~over]
            if not len(alive):
                break
            key = state[alive] * 256 + letters[starts[alive] + depth]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[at] == key
            alive, at = alive[there], at[there]
            state[alive] = self.targets[at]
            number[alive] += self.numbers[at]
            depth += 1
        return place


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


CACHES["bpe"] = vocabulary.cache_clear


def count_words(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """word, n over the whole corpus: counted in each task, then summed."""
    small_batches(docs.sparkSession)
    name = sent(docs.sparkSession, tokenizer_path)

    def count(batches):
        vocab, n = vocabulary(SparkFiles.get(name)), Counter()
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                for text in batch.column(0).slice(i, DOCS_AT_ONCE).to_pylist():
                    if text:
                        n.update(vocab.parts(text))
                if len(n) > COUNTED_WORDS:
                    yield from counted(n)
                    n.clear()
        yield from counted(n)

    def counted(n):
        words = list(n)
        for i in range(0, len(words), 50_000):
            some = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([n[w] for w in some], pa.int64())], names=["word", "n"])

    return docs.select(text_col).mapInArrow(lean(count, "bpe"), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def sent(spark: SparkSession, path: str) -> str:
    """Sends a file to all executors, those that start later as well; the name there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def build_lexicon(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS, text_col: str = "text") -> str:
    """Compiles the corpus's most frequent words; the name under which executors have the file."""
    import io

    spark, vocab = docs.sparkSession, vocabulary(tokenizer_path)
    counted = count_words(docs, tokenizer_path, text_col).withColumn("size", F.floor(F.log("n") * 16))
    counted = written(counted.where("n > 1"), "word-counts")
    # The least count that leaves no more than lexicon_words words, from a histogram of some hundred sizes.
    least, total = None, 0
    for r in counted.groupBy("size").count().orderBy(F.desc("size")).collect():
        total += r["count"]
        if total > lexicon_words:
            break
        least = r["size"]
    top = counted.where(F.col("size") >= least).select("word").collect() if least is not None else []
    entries = {r["word"].encode("utf-8"): vocab.merge(r["word"]) for r in top}
    buffer = io.BytesIO()
    np.save(buffer, compile_lexicon(entries))
    path = shared_path(spark, "lexicon") + ".npy"
    jvm = spark._jvm
    goal = jvm.org.apache.hadoop.fs.Path(path)
    out = goal.getFileSystem(spark._jsc.hadoopConfiguration()).create(goal, True)
    data = buffer.getvalue()
    for i in range(0, len(data), 1 << 20):
        out.write(bytearray(data[i : i + (1 << 20)]))
    out.close()
    return sent(spark, path)


class Encoder:
    """Encodes texts with the memory-mapped lexicon and, for other words, the merges."""

    def __init__(self, vocab: Vocabulary, lexicon: Lexicon) -> None:
        self.vocab, self.lexicon = vocab, lexicon
        self.memo: dict[str, bytes] = {}
        #: The lexicon's ids, as they are put together.
        self.known = lexicon.ids.astype("<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, little-endian unsigned 32-bit."""
        parts = [self.vocab.parts(t) if t else [] for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        new = list(set(filterfalse(memo.__contains__, chain.from_iterable(parts))))
        place = self.lexicon.places([w.encode("utf-8") for w in new])
        there = np.flatnonzero(place >= 0)
        at = place[there]
        for i, a, b in zip(there.tolist(), (self.lexicon.starts[at] * 4).tolist(), (self.lexicon.starts[at + 1] * 4).tolist(), strict=True):
            memo[new[i]] = self.known[a:b]
        rest = [new[i] for i in np.flatnonzero(place < 0).tolist()]
        memo.update(zip(rest, self.vocab.merge_many(rest), strict=True))
        return [b"".join(map(memo.__getitem__, p)) for p in parts]


def _mapped(vocab_name: str, lexicon_name: str) -> Encoder:
    return Encoder(vocabulary(SparkFiles.get(vocab_name)), Lexicon(np.load(SparkFiles.get(lexicon_name), mmap_mode="r")))


def encode_documents(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False) -> DataFrame:
    """The columns ``keep``, n_tokens and either ids (array) or, with ``digests``, ids_sha256 and decoded_sha256."""
    lexicon_name = build_lexicon(docs, tokenizer_path, lexicon_words, text_col)
    vocab_name = tokenizer_path.rsplit("/", 1)[1]
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    added = [("ids_sha256", StringType()), ("decoded_sha256", StringType())] if digests else [("ids", ArrayType(IntegerType()))]
    schema = StructType([*rows.schema.fields[: len(keep)], StructField("n_tokens", LongType()), *[StructField(n, t) for n, t in added]])

    def run(batches):
        encoder = _mapped(vocab_name, lexicon_name)
        for batch in batches:
            for i in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(i, DOCS_AT_ONCE)
                found = encoder.encode(part.column(len(keep)).to_pylist())
                own = [part.column(k) for k in range(len(keep))]
                n = pa.array([len(x) // 4 for x in found], pa.int64())
                if digests:
                    decoded = [hashlib.sha256(encoder.vocab.decode_bytes(np.frombuffer(x, dtype="<u4").tolist())).hexdigest() for x in found]
                    more = [pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string()), pa.array(decoded, pa.string())]
                else:
                    more = [pa.array([np.frombuffer(x, dtype="<u4").astype(np.int32) for x in found], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*own, n, *more], names=[*keep, "n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])])

    return rows.mapInArrow(lean(run, "bpe"), schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and text, from rows of ids; null ids give the empty text."""
    small_batches(encoded.sparkSession)
    name = sent(encoded.sparkSession, tokenizer_path)
    rows = encoded.select(*keep, F.col(ids_col).alias("__ids"))
    schema = StructType([*rows.schema.fields[: len(keep)], StructField("text", StringType())])

    def run(batches):
        vocab = vocabulary(SparkFiles.get(name))
        for batch in batches:
            texts = pa.array([vocab.decode(x or []) for x in batch.column(len(keep)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), texts], names=[*keep, "text"])

    return rows.mapInArrow(lean(run, "bpe"), schema)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every whole text of ``documents``, as digests; a row a document, a null text is an empty one."""
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)
