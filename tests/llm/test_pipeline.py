"""The pipeline on a small corpus against brute force."""

from collections import Counter

import numpy as np

import corpus_pipeline


def test_pipeline(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(8)
    words = {"en": [f"the{a}on" for a in "abcdefgh"] + ["with", "that"], "de": [f"der{a}ung" for a in "abcdefgh"] + ["über", "nicht"]}
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(words[lang], 80)), lang, "hot" if i % 2 else f"s{i % 6}", 1))
    rows += [(100, rows[0][1], "de", "hot", 1), (101, rows[1][1] + " end", None, "s0", 1), (102, None, "en", "s0", 1), (103, "", None, None, 1), (104, "123 !", "en", "s1", 1), (105, rows[2][1], "en", None, 1)]
    ddl = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, ddl).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path)).cache()
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r["doc_id"] for r in seen["language_id"]} == {r[0] for r in rows} - {102, 103, 104} and len(seen["language_id"]) == len(rows) - 3
    assert {r["doc_id"]: r["lang"] for r in seen["language_id"]}[101] == "en"
    assert {r["doc_id"] for r in seen["near_dedup"]} == set(range(60)) and len(seen["near_dedup"]) == 60
    taken = Counter(r["doc_id"] for r in seen["mixing"])
    assert set(taken) == set(range(60)) and max(taken.values()) <= 2
    tokens = Counter()
    for r in seen["mixing"]:
        tokens[r["source"]] += len(r["text"].split())
    assert tokens["hot"] == 30 * 80  # the largest source is seen once, the others up to twice
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {(r["doc_id"], tuple(r["ids"])) for r in seen["bpe"]} == {(r["doc_id"], tuple(own.encode(r["text"], add_special_tokens=False).ids)) for r in seen["mixing"]}
    assert Counter(r["doc_id"] for r in seen["bpe"]) == taken
    spark.createDataFrame([], ddl).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
