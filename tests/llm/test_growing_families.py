"""Families of similar texts, whose pairs grow with the square of the corpus, against brute force; words merged side by side."""

import random

import numpy as np
import pyarrow as pa

from codeweft.llm import minhash


def test_sets_go_once_to_each_two_cells(spark, monkeypatch):
    """200 texts around one base, most of their pairs below the threshold: far fewer sets are sent than pairs are checked."""
    monkeypatch.setattr(minhash, "BLOCK", 40)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    texts = [" ".join(w if rng.random() > 0.08 else f"x{rng.random()}" for w in base) for _ in range(200)] + [None, "", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(7, texts[8])], "doc_id long, text string")
    sets = [{tuple((t or "").split()[k : k + 2]) for k in range(max(0, len((t or "").split()) - 1))} for t in texts]
    rows = [(a, b) for a in range(200) for b in range(a + 1, 200)] + [(0, 202), (200, 201)]
    pairs = spark.createDataFrame(rows, "a long, b long")
    similar = lambda x, y: len(x | y) > 0 and 100 * len(x & y) >= 80 * len(x | y)
    want = {(a, b) for a, b in rows if similar(sets[a], sets[b]) or 7 in (a, b) and any(similar(sets[8], sets[k]) for k in (a, b) if k != 7)}
    seen = {}

    def placed(*given):
        seen["placed"] = old(*given).cache()
        return seen["placed"]

    old = minhash._placed
    monkeypatch.setattr(minhash, "_placed", placed)
    found = minhash._verified(pairs, docs, 2, 80, "doc_id", "text").collect()
    assert len(found) == len(want) > 0 and {(r["a"], r["b"]) for r in found} == want
    sent = {(r["i"], r["j"], x) for r in seen["placed"].collect() for x in (r["a"], r["b"])}
    assert seen["placed"].count() == len(rows) and len(sent) < len(rows) / 10


def test_bands_are_compared_many_at_once(spark):
    """Groups that end within a batch or go on in the next one, small ones and one of over SMALL_GROUP rows."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 60000, size=(3, minhash.REGISTERS), dtype=np.uint16)
    rows, bands = [], [(0, 150), (1, 2), (2, 1), (3, 7), (4, 2)]
    for band, size in bands:
        for _ in range(size):
            r = base[band % 3].copy()
            r[rng.random(minhash.REGISTERS) < rng.uniform(0, 0.3)] = rng.integers(0, 60000)
            rows.append((band, len(rows), len(rows) // 2, 300, r))
    reps = spark.createDataFrame([(d, n, r.tobytes()) for _, d, _, n, r in rows], "doc_id long, n long, registers binary")
    members = spark.createDataFrame([(b, d, x) for b, d, x, _, _ in rows], "band long, doc_id long, label long")
    want = set()
    for k, (b, d, x, n, r) in enumerate(rows):
        for b2, d2, x2, n2, r2 in rows[k + 1 :]:
            close = minhash.estimated_jaccard(r, r2, np.array([n]), np.array([n2])) >= minhash.least_estimate(0.8, np.array([n]), np.array([n2]))
            if b == b2 and x != x2 and close.all():
                want.add((d, d2))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        found = minhash._cross_pairs(members, reps, 0.8)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()  # a call of Python a band
        assert {(r["a"], r["b"]) for r in found.collect()} == want and want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_are_kept_whole():
    keys = [0] * 5 + [1] * 2 + [2] * 9 + [3]
    all_rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array([0] * 17), pa.array(range(17))], names=["i", "j", "x"])
    for size in range(1, 18):
        parts = list(minhash._whole_groups(all_rows.slice(k, size) for k in range(0, 17, size)))
        assert [x for p in parts for x in p.column(2).to_pylist()] == list(range(17))
        assert sum(len(set(p.column(0).to_pylist())) for p in parts) == 4


def test_words_merged_side_by_side():
    import public_tokenizers

    from codeweft.llm.bpe import MOST_SIDE, Vocabulary

    vocab, rng = Vocabulary(public_tokenizers.path("word_bpe_49k.json")), random.Random(6)
    words = ["a", "é", "日本", "!!", "the", "aaaaaaaaaaaa", *vocab.special, "x" * MOST_SIDE, "x" * (MOST_SIDE + 1), "the" * 40]
    words += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéß1日") for _ in range(rng.randint(1, 30))) for _ in range(6000)]
    assert vocab.merge_many(words) == [np.array(vocab.merge(w), dtype="<u4").tobytes() for w in words]
    assert vocab.merge_many([]) == []
