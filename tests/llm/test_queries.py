"""The registered queries on a small folder of tables, every column against brute force."""

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from codeweft.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source): copies, a hot source, a hot text without an id, repeated rows and ids, ends of the long range."""
    rng = np.random.default_rng(11)
    words = {"en": [f"th{a}on{b}" for a in "abcdefgh" for b in "xyz"], "de": [f"{a}ung{b}ß" for a in "klmnopqr" for b in "abc"], "fr": [f"é{a}oue{b}" for a in "stuvwdfg" for b in "lmn"]}
    rows = [(i, " ".join(rng.choice(words[lang], int(rng.integers(3, 90)))), lang, "hot" if i % 3 else f"s{i % 4}") for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    rows += [(200 + i, rows[i][1], rows[i][2], "hot") for i in range(12)] + [(220 + i, rows[i][1] + " tail", rows[i][2], "s1") for i in range(12)]
    rows += [(None, "", "en", "hot")] * 30 + [(None, "x y", None, None)] * 2 + [(240, None, "en", "s0"), (241, "", "de", None), (242, "12 34 !", "en", "s1"), (243, "one", None, "s2")]
    rows += [(5, "quite another text with the id five", "en", "hot"), (6, rows[6][1], "de", "hot"), (-(1 << 63), "the first of all ids", "en", "s3"), ((1 << 63) - 1, "the last of all ids", "en", "s3")]
    return rows + [(250, "Released under the MIT License.\nthe mit license, apache LICENSE and the GNU General Public License", "en", "s2"), (251, "long " * 20_000, "en", "s2")]


DDL = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    # Columns with the names that operators use must not matter.
    clash = {c: F.lit(-1) for c in ("n_chars", "tie", "need", "copies", "hash", "at", "block", "k", "n", "registers", "grp", "size", "held_out", "__text")}
    spark.createDataFrame(corpus(), DDL).withColumns(clash).write.parquet(str(path / "documents.parquet"))
    return str(path)


def run(spark, folder, name):
    return QUERIES[name](spark, folder).collect()


def hashed(*values, seed=42) -> int:
    """Spark's xxhash64 of ints (4 bytes), longs (as ``(value,)``), strings and nulls."""
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def test_token_counts(spark, folder):
    kept: dict = {}
    for i, t, lang, s in corpus():
        key = (i is None, i or 0, s is not None, s or "", lang is not None, lang or "")
        if t not in kept or key < kept[t][0]:
            kept[t] = key, s, lang
    want: Counter = Counter()
    for t, (_, s, lang) in kept.items():
        for v, p in (("space-1", WORD), ("alnum-1", re.compile("[0-9A-Za-z\x80-\U0010ffff]+"))):
            want[s, lang, v, "docs"] += 1
            want[s, lang, v, "tokens"] += len(p.findall(t or ""))
    got = {}
    for r in run(spark, folder, "op1_token_counts"):
        got |= {(r["source"], r["lang"], r["tokenizer"], c): r[c] for c in ("docs", "tokens")}
    assert got == dict(want)


def test_bpe(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    own.no_truncation()
    want = Counter()
    for i, t, _, _ in corpus():
        ids = own.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, folder, "op3_bpe")) == want


def test_licenses(spark, folder):
    phrases = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
    want = Counter()
    for i, t, _, _ in corpus():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        found = [(k, label) for label, p in phrases.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        want[i, len(words), len(found), min(found)[0] if found else None, max(found)[0] if found else None, ",".join(sorted({x for _, x in found})), "apache,gpl,mit" if found else "", 1.0 if found else 0.0] += 1
    rows = run(spark, folder, "op5_licenses")
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")) for r in rows) == want


def test_mixing(spark, folder):
    """The mix worked out one document at a time: exponent by bisection, blocks, permutations, the last block's cut."""
    rows = [(i, s, len(WORD.findall(t or ""))) for i, t, _, s in corpus()]
    tokens: Counter = Counter()
    for _, s, n in rows:
        tokens[s] += n
    total, limit = sum(tokens.values()), 2.0
    share = {s: n / total for s, n in tokens.items() if n}
    most, least = max(share.values()), min(share.values())
    meets = lambda a: most ** (1 - a) * least ** (a - 1) <= limit + 1e-9
    low, high = 0.0, 1.0
    for _ in range(200):
        low, high = (low, (low + high) / 2) if meets((low + high) / 2) else ((low + high) / 2, high)
    a = 0.0 if meets(0.0) else high
    z = sum(p**a for p in share.values())
    budget = round(total * most ** (1 - a) * z)
    goal = {s: max(n, round(p**a / z * budget)) for s, n in tokens.items() if n for p in [share[s]]}
    out = run(spark, folder, "op6_mixing")
    got = {s: sum(r["n_tokens"] for r in out if r["source"] == s) for s in goal}
    for s, n in goal.items():  # a document may not fit in what is left; targets round the last digit of the weight
        assert n - max(k for _, x, k in rows if x == s) - 2 <= got[s] <= n + 2, s
    want: Counter = Counter()
    target = {s: int(round(round(share[s] ** a / z, 15) * budget)) for s in goal}
    for s in tokens:
        whole, rest = divmod(max(target[s], tokens[s]), tokens[s]) if tokens[s] else (1, 0)
        own = [(i, n, hashed(17, None if i is None else (i,), (n,))) for i, x, n in rows if x == s]
        blocks = defaultdict(list)
        for i, n, at in own:
            blocks[signed(at) % 16].append((i, n, at))
        for epoch in range(whole + (rest > 0)):
            before = 0
            for rank, b in enumerate(sorted(blocks, key=lambda b: (signed(hashed(17, (epoch,), s, (b,))), b))):
                size, room = sum(n for _, n, _ in blocks[b]), rest - before
                if epoch == whole and before >= rest:
                    continue
                taken = blocks[b]
                if epoch == whole and size > room:
                    draws = sorted(((signed(hashed(17, (epoch,), (signed(at),))), i is not None, i or 0, signed(at)), i, n) for i, n, at in blocks[b] if n)
                    taken, used = [], 0
                    for _, i, n in draws:
                        used += n
                        if used > room:
                            break
                        taken.append((i, n, 0))
                for i, n, _ in taken:
                    want[i, s, n, epoch, b, rank] += 1
                before += size
    have = Counter((r["doc_id"], r["source"], r["n_tokens"], r["epoch"], r["block"], r["rank"]) for r in out)
    assert have == want


def python_fingerprints(texts: list[str], lexicon: set[int]) -> list[str]:
    from codeweft.llm.fingerprints import LEVELS

    out = []
    for t in texts:
        every = {signed(hashed(w)) for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower()) if w}
        terms = sorted(every & lexicon) or sorted(every)
        code = lambda some: f"{hashed(*[(x,) for x in some]):X}"
        codes, top = [code(terms)], 64
        for bits, n in LEVELS:
            top -= bits
            for k in range(n):
                own = [x for x in terms if ((x % (1 << 64)) >> top) & ((1 << bits) - 1) == k]
                codes.append(code(own) if own else "-")
        out.append(",".join(codes))
    return out


def python_likeness(a: str, b: str) -> float:
    pairs = [(x, y) for x, y in zip(a.split(","), b.split(","), strict=True) if (x, y) != ("-", "-")]
    return sum(x == y for x, y in pairs) / len(pairs)


def test_fingerprints(spark, folder):
    from codeweft.llm.fingerprints import IDF_BAND

    rows = sorted(((i is not None, i or 0, hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t, _, _ in corpus()), key=lambda r: r[:3])
    df = Counter(x for r in rows for x in {signed(hashed(w)) for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r[3].lower()) if w})
    least = max(2, math.ceil(len(rows) * math.exp(-IDF_BAND[1])))
    lexicon = {x for x, n in df.items() if least <= n <= max(least, len(rows) * math.exp(-IDF_BAND[0]))}
    texts = [r[3] for r in rows]
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for t, after in zip(texts, texts[1:] + texts[:1], strict=True)]
    marks, marks2 = python_fingerprints(texts, lexicon), python_fingerprints(edited, lexicon)
    want = Counter()
    for k, (there, i, _, t) in enumerate(rows):
        want[i if there else None, len(t), hashlib.sha256(edited[k].encode()).hexdigest(), marks[k], marks2[k], round(python_likeness(marks[k], marks2[k]), 9), round(python_likeness(marks[k], marks[(k + 1) % len(rows)]), 9)] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in run(spark, folder, "op8_fingerprints"))
    assert got == want


def test_order_of_many_equal_rows(spark):
    """Copies of one row, split into runs, follow one another."""
    from codeweft.llm.fingerprints import followed

    rows = spark.createDataFrame([(None, "a", "hot")] * 57 + [(1 << 60, "b", "far"), (3, "c", "three"), (3, "d", "drei")], "doc_id long, tie string, v string")
    got = Counter((r["v"], r["next_v"]) for r in followed(rows, ["v"], copies_at_once=10).collect())
    assert got == {("hot", "hot"): 56, ("hot", "three"): 1, ("three", "drei"): 1, ("drei", "far"): 1, ("far", "hot"): 1}
    cut = followed(rows.where("doc_id is not null"), ["v"], need=F.lit(2), cut=("v",)).collect()
    assert {(r["v"], r["next_v"]) for r in cut} == {("three", "dr"), ("drei", "fa"), ("far", "th")}
    assert [tuple(r) for r in followed(rows.where("doc_id > 3"), ["v"]).collect()] == [(1 << 60, "far", "far")]
    assert followed(rows.limit(0), ["v"]).count() == 0


def test_language_id(spark, folder):
    rows = run(spark, folder, "op9_language_id")
    given = corpus()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    assert Counter((r["doc_id"], r["held_out"]) for r in rows) == Counter((i, held(i)) for i, _, _, _ in given)
    silent = {i for i, t, _, _ in given if not any(map(str.isalpha, t or ""))}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in silent) or r["doc_id"] is None for r in rows)
    true = {i: lang for i, t, lang, _ in given if i is not None and 0 <= i < 150 and i not in (5, 6)}
    tested = [r for r in rows if r["doc_id"] in true and r["held_out"]]
    assert len(tested) > 20 and all(r["lang_pred"] == true[r["doc_id"]] and 0 < r["score"] <= 1 for r in tested)


def test_sharding(spark, folder):
    rows, given = run(spark, folder, "op10_sharding"), corpus()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in given)
    assert {r["law"] for r in rows} == {"bytes"} and all(0 <= r["shard"] < 40 and r["grown_shard"] is None for r in rows)
    for s in range(40):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    text = {(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())): t for i, t, _, _ in given if t != ""}
    where = defaultdict(set)
    for r in rows:
        where[text.get((r["doc_id"], r["size"], r["text_crc32"]), "")].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    # No shard without the one group that is larger than a share may be far from the mean of the rest.
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    rest = sorted(loads.values())[:-1]
    assert len(rest) == 39 and max(rest) - min(rest) <= 1100


def test_sharding_is_as_even_as_the_best():
    """Differencing against all placements of a few groups: never more than a few percent above the least largest shard."""
    from itertools import product

    from codeweft.llm.sharding import differencing

    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = rng.integers(1, 100, 9)
        best = min(np.bincount(p, weights=sizes, minlength=3).max() for p in product(range(3), repeat=9))
        assert np.bincount(differencing(sizes.tolist(), 3), weights=sizes, minlength=3).max() <= best * 1.12


def test_embeddings_over_many_lists(spark, tmp_path):
    """64 lists, of which each vector probes 8: planted pairs at 0.93 to 0.96, links of equal labels alone, recall of at least 0.98."""
    from codeweft.llm.embeddings import PROBES, centroids_for
    from codeweft.llm.components import roots

    rng, d, n = np.random.default_rng(1), 48, 6800
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    a = unit(rng.normal(size=(n // 2, d)))
    r = rng.normal(size=a.shape)
    r = unit(r - (r * a).sum(axis=1, keepdims=True) * a)
    cos = rng.uniform(0.925, 0.96, size=(len(a), 1))
    x = np.concatenate([a, cos * a + np.sqrt(1 - cos**2) * r]).astype("float32").astype(float)
    label = [int(i % 3) for i in range(n // 2)] * 2
    assert centroids_for(n, n) ** 2 >= 64 and PROBES == 8
    spark.createDataFrame([(i, v.tolist(), g) for i, (v, g) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op7_embedding_duplicates"](spark, str(tmp_path)).collect()}
    y, g = unit(x), np.array(label)
    links = [(int(p), int(q)) for p, q in np.argwhere((y @ y.T >= 0.93) & (g[:, None] == g[None, :])) if p < q]
    group, degree = roots(links), Counter(k for p in links for k in p)
    assert len(links) > 2000 and len(got) == n
    assert all(k <= degree[i] for i, (k, _) in got.items())  # none below the threshold
    recall = sum(k for k, _ in got.values()) / sum(degree.values())
    print("recall", recall)
    assert recall >= 0.98
    assert sum(c == group.get(i, i) for i, (_, c) in got.items()) >= 0.98 * n


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op2_url_filter", "op7_embedding_duplicates")])
def test_empty_documents(spark, tmp_path, name):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "documents.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0
