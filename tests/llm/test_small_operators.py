"""Each operator against brute force on small tables: nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long, size long, shard int, n_tokens long, score double, component_id long"


def docs(spark, rows):
    """Rows of (doc_id, text, source), with columns that operators use as names."""
    return spark.createDataFrame([(i, t, "xx", s, -1, -1, -1, -1, -1.0, -1) for i, t, s in rows], DDL)


BASE = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"),
    (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "a"),
    (3, None, "a"),
    (4, "", "b"),
    (5, "   \n\t ", None),
    (6, "one", "b"),
    (7, "word " * 30_000, "b"),
    (8, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda", "c"),
    (9, "été über façon niño", "c"),
    (None, "no id here at all", "c"),
    (6, "another text with the id six", "b"),
    (8, "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda", "c"),
]


# Sharding


def test_differencing():
    from codeweft.llm.sharding import differencing

    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1000, 500)
    loads = np.bincount(differencing(sizes.tolist(), 7), weights=sizes, minlength=7)
    assert loads.max() - loads.min() <= 2
    assert sorted(differencing([8, 7, 6, 5, 4], 2).tolist()) in ([0, 0, 0, 1, 1], [0, 0, 1, 1, 1])
    held = [5000, 0, 0]
    loads = np.bincount(differencing(sizes.tolist(), 3, held), weights=sizes, minlength=3) + held
    assert loads.max() - loads.min() <= 2
    assert len(differencing([], 3)) == 0


def test_sharding(spark):
    from codeweft.llm.sharding import shard_documents

    many = BASE + [(100 + i, "x" * (i % 37) + str(i % 50), "a") for i in range(300)]
    rows = shard_documents(docs(spark, many), 4, groups_per_bucket=40).collect()
    assert len(rows) == len(many)
    text_of = Counter((i, t) for i, t, _ in many)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter({(i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())): 0 for i, t in text_of}) + Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in many)
    by = {}
    for r in rows:
        by.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    # the null and the empty text are groups of their own
    assert all(len(s) == 1 for k, s in by.items() if k != (0, 16)) and len(by[0, 16]) <= 2
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows)))
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    # one text holds nearly all bytes: the other shards share the rest evenly
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    small = sorted(loads.values())[:3]
    assert small[-1] - small[0] <= 250
    assert shard_documents(docs(spark, [])).count() == 0


# Token counts


def test_ledger(spark, tmp_path):
    from codeweft.llm.tokencounts import Ledger, deletes, inserts, revisions

    rows = lambda *r: spark.createDataFrame([(*x, None) for x in r], "source string, lang string, tokenizer string, tokens long, old_tokens long")
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    first = inserts(rows(("a", "en", "v1", 5), ("a", "en", "v1", 5), (None, None, "v1", None)))
    assert ledger.commit("b1", first) and not ledger.commit("b1", first)
    with pytest.raises(ValueError):
        ledger.commit("b1", inserts(rows(("a", "en", "v1", 6))))
    assert ledger.commit("b2", revisions(rows(("a", "en", "v1", 9)).withColumn("old_tokens", F.lit(5))))
    assert ledger.commit("b3", deletes(rows(("a", "en", "v1", 5)))) and ledger.commit("b4", inserts(rows()))
    want = {("a", "en", "v1", 1, 9), (None, None, "v1", 1, 0)}
    assert {tuple(r) for r in ledger.totals().collect()} == want
    ledger.compact()
    assert {tuple(r) for r in ledger.totals().collect()} == want and ledger.batches() == ["b1", "b2", "b3", "b4"] and not ledger.commit("b2", revisions(rows(("a", "en", "v1", 9)).withColumn("old_tokens", F.lit(5))))


# URLs


def test_urls(spark):
    from codeweft.llm.urlfilter import judge_urls

    urls = ["http://A.Example.org/en/1x", "https://example.org/es/2", "https://www.x.com/fr/1?utm_source=f", "http://x.com/de/", "http://bad.net/p/?ref=1&q=2#t", "http://bad.net/other", "http://org", "ftp://a:8/b", "nothing", None, "", "http://notexample.org.net/es/", "http://x.net?q=/a"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("block", F.lit(1))
    rows = {r["page_id"]: r for r in judge_urls(pages, spark.createDataFrame([("bad.net/p?q=2",), ("bad.net/p?q=2",), (None,), ("",)], "canonical string")).collect()}
    got = [(rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) for i in range(len(urls))]
    assert got == [
        ("a.example.org", "/en/1x", "example.org/en/1", "block"), ("example.org", "/es/2", "example.org/es/", "block"), ("www.x.com", "/fr/1", "com/fr/", "allow"), ("x.com", "/de/", "com/de/", "block"),
        ("bad.net", "/p/", None, "block"), ("bad.net", "/other", None, "allow"), ("org", "", None, "allow"), ("a:8", "/b", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("notexample.org.net", "/es/", None, "allow"), ("x.net", "", None, "allow"),
    ]
    assert judge_urls(pages.limit(0), spark.createDataFrame([], "canonical string")).count() == 0


def test_bloom_has_no_false_negatives(spark):
    from codeweft.llm.urlfilter import listed_urls

    listed = spark.range(2000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    probes = spark.range(4000).select(F.concat(F.lit("h/"), "id").alias("canonical"), "id")
    for blocks in (100_000, 0):
        rows = listed_urls(probes, listed, broadcast_blocks=blocks)
        assert rows.count() == 4000 and rows.where("listed <> (id < 2000)").count() == 0


# BPE


def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from codeweft.llm.bpe import Lexicon, Vocabulary, compile_lexicon, decode_documents, encode_documents

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = BASE + [(20, "Hello WORLD's 123, <|endoftext|>x<|startoftext|>", "a"), (21, "日本語 ﬁ ½ İ ΣΑΣ ́e \U0001f600", "a"), (22, "thé" * 400 + " don't", "a")]
    own = Tokenizer.from_file(path)
    want = Counter((i, tuple(own.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows)
    coded = encode_documents(docs(spark, rows), path, lexicon_words=20)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in coded.collect()) == want
    back = decode_documents(coded.where("doc_id in (20, 21, 3)"), path).collect()
    assert {r["doc_id"]: r["text"] for r in back} == {i: own.decode(own.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, t, _ in rows if i in (20, 21, 3)}
    digests = encode_documents(docs(spark, rows).where("doc_id = 20"), path, digests=True).first()
    assert digests["ids_sha256"] == hashlib.sha256(np.array(own.encode(rows[-3][1], add_special_tokens=False).ids, dtype="<u4").tobytes()).hexdigest()
    assert encode_documents(docs(spark, []), path).count() == 0
    vocab = Vocabulary(path)
    words = ["cat", "cats", "rat", "rats", "é", "concatenation"]
    lexicon = Lexicon(compile_lexicon({w.encode(): vocab.merge(w) for w in words}))
    assert lexicon.find([w.encode() for w in words]) == [vocab.merge(w) for w in words] and lexicon.find([b"ca", b"catss", b"", b"zzz"]) == [None] * 4
    assert lexicon.states < sum(map(len, words))  # suffixes are shared


# Licences


def test_licenses(spark):
    from codeweft.llm.licenses import PHRASES, scan_licenses

    texts = ["Released under the MIT License.", "mit  LICENSE mit license", "the Apache-License; GNU General Public License\nAll rights reserved", "summit license", None, "", "Intro. Licensed under CC BY-NC 4.0. Out", "license mit", "general public\nlicense x mit_license"]
    rows = {r["doc_id"]: r for r in scan_licenses(docs(spark, [(i, t, "a") for i, t in enumerate(texts)])).collect()}
    for i, text in enumerate(texts):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
        found = [(k, label) for label, p in PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = rows[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(found)), text
        assert (r["first_word"], r["last_word"]) == ((min(found)[0], max(found)[0]) if found else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in found}))
    assert rows[0]["labels"] == "mit" and rows[0]["score"] == 1.0 and rows[2]["labels"] == "apache,gpl,proprietary" and rows[6]["labels"] == "cc-by-nc" and rows[3]["labels"] == ""
    assert scan_licenses(docs(spark, [])).count() == 0


# Mixing


def test_mixing(spark):
    from codeweft.llm.mixing import mix_sources, temperature_weights

    rows = [(i, "w " * (1 + i % 9), "big" if i % 4 else "small") for i in range(400)] + [(1000, None, None), (1001, "", "none")]
    table = docs(spark, rows)
    tokens = Counter()
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    counts = spark.createDataFrame([(s, n) for s, n in tokens.items() if n], "source string, tokens long")
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}
    even = temperature_weights(counts, max_repeat=100.0)
    assert even.exponent == pytest.approx(0, abs=1e-9)
    mix = temperature_weights(counts, max_repeat=1.5)
    assert max(r["repeats"] for r in mix.sources.collect()) == pytest.approx(1.5, abs=0.01)
    target = -sum(p * np.log(p) for p in share.values()) + 0.05
    mix = temperature_weights(counts, min_entropy=target)
    w = [r["weight"] for r in mix.sources.collect()]
    assert -sum(p * np.log(p) for p in w) == pytest.approx(target, abs=1e-6) and sum(w) == pytest.approx(1)
    out = mix_sources(table, max_repeat=1.5).collect()
    seen = Counter(r["doc_id"] for r in out)
    assert set(seen) == {i for i, _, _ in rows} and max(seen.values()) <= 2
    got = Counter()
    for r in out:
        got[r["source"]] += r["n_tokens"]
    assert got["big"] == tokens["big"] and abs(got["small"] - 1.5 * tokens["small"]) <= 9
    half = mix_sources(table, max_repeat=1.0, budget=total // 2).collect()
    assert abs(sum(r["n_tokens"] for r in half) - total // 2) <= 20
    whole = mix_sources(table, max_repeat=1.5, columns=table.columns)
    assert whole.columns == table.columns and Counter(r["doc_id"] for r in whole.collect()) == seen
    assert mix_sources(docs(spark, [])).count() == 0


# Fingerprints


def test_fingerprints(spark):
    from codeweft.llm.fingerprints import followed, fingerprints, likeness

    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(100, texts[0], "a"), (101, None, "a"), (102, "", "a"), (103, texts[0] + " extra", "a"), (104, texts[0], "a")]
    found = {r["doc_id"]: r["fingerprint"] for r in fingerprints(docs(spark, rows)).collect()}
    assert found[0] == found[100] == found[104] and found[101] == found[102] and len({found[i] for i in range(60)}) == 60
    near = lambda a, b: spark.createDataFrame([(found[a], found[b])], "a string, b string").select(likeness(F.col("a"), F.col("b"))).first()[0]
    assert near(0, 100) == 1.0 and near(0, 103) > 0.5 > near(0, 1) and near(101, 102) == 1.0
    assert fingerprints(docs(spark, [])).count() == 0
    line = spark.createDataFrame([(i * i if i else None, i, str(i)) for i in range(50)] + [(4, 0, "four")], "doc_id long, tie long, v string")
    rows = followed(line, ["v"]).collect()
    order = ["0", "1", "four", *map(str, range(2, 50))]
    assert {r["v"]: r["next_v"] for r in rows} == dict(zip(order, order[1:] + order[:1], strict=True)) and len(rows) == 51


# Languages


def test_language_id(spark):
    from codeweft.llm.langid import identify, train

    rng = np.random.default_rng(5)
    syllables = {"aa": ["ban", "tok", "rim"], "bb": ["zul", "vex", "qoj"], "cc": ["éte", "ñau", "çoi"]}
    text = lambda lang: " ".join("".join(rng.choice(syllables[lang], 2)) for _ in range(40))
    rows = [(i, text(lang), lang) for i in range(60) for lang in syllables]
    labelled = spark.createDataFrame(rows, "id long, text string, lang string")
    model = train(labelled.unionByName(spark.createDataFrame([(None, "x", "aa"), (1, None, "bb"), (2, "y", None)], "id long, text string, lang string")))
    asked = [(i, text(lang), lang) for i, lang in enumerate(syllables)] + [(10, None, "und"), (11, "123 ½ !", "und"), (12, "", "und"), (13, "zulvex " * 100_000, "bb")]
    table = spark.createDataFrame(asked, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = identify(table, model, ["doc_id", "lang", "score"], names=("p", "s")).collect()
    assert all(r["p"] == r["lang"] and 0 <= r["s"] <= 1 for r in found) and len(found) == len(asked)
    none = train(labelled.limit(0))
    assert {r["lang_pred"] for r in identify(table, none, ["doc_id"]).collect()} == {"und"}
    assert identify(table.limit(0), model, ["doc_id"]).count() == 0
