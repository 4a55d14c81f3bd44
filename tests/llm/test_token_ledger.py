"""The ledger with writers that are lost, or that come between; counts of a real vocabulary."""

import shutil
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeweft.llm.tokencounts import Ledger, encoder_counts, inserts


def counts(spark, n, source="a"):
    return inserts(spark.createDataFrame([(source, "en", "v1", n)], "source string, lang string, tokenizer string, tokens long"))


def totals(ledger):
    return {tuple(r) for r in ledger.totals().collect()}


def test_lost_while_compacting(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    for k in range(3):
        assert ledger.commit(f"b{k}", counts(spark, 10 + k))
    want = totals(ledger)
    shutil.copytree(tmp_path / "ledger" / "batches", tmp_path / "kept")
    ledger.compact()
    assert totals(ledger) == want == {("a", "en", "v1", 3, 33)}
    for old in (tmp_path / "kept").iterdir():  # as if the driver had been lost before it deleted what the new folder covers
        shutil.copytree(old, tmp_path / "ledger" / "batches" / old.name)
    again = Ledger(spark, ledger.path)
    assert totals(again) == want and again.batches() == ["b0", "b1", "b2"] and not again.commit("b1", counts(spark, 11))
    (tmp_path / "ledger" / "staged-lost" / "sums").mkdir(parents=True)  # lost before the rename: as if it had never been
    assert totals(again) == want
    assert again.commit("b3", counts(spark, 1, "z"))
    again.compact()
    assert totals(again) == want | {("z", "en", "v1", 1, 1)} and again.batches() == ["b0", "b1", "b2", "b3"]


class Late:
    """A file system on which another writer's folder shows only after the first look."""

    def __init__(self, fs):
        self._fs, self._looks = fs, 0

    def __getattr__(self, name):
        return getattr(self._fs, name)

    def exists(self, path):
        self._looks += 1
        return self._looks > 1 and self._fs.exists(path)


@pytest.mark.parametrize("same", [True, False])
def test_two_writers_of_one_batch(spark, tmp_path, same):
    first, second = Ledger(spark, f"file://{tmp_path}/ledger"), Ledger(spark, f"file://{tmp_path}/ledger")
    second._known = lambda batch, known=second._known, calls=[]: known(batch) if calls else calls.append(1) or []
    second._fs = Late(second._fs)
    assert first.commit("b", counts(spark, 5))
    if same:
        assert not second.commit("b", counts(spark, 5))
    else:
        with pytest.raises(ValueError):
            second.commit("b", counts(spark, 6))
    assert totals(first) == {("a", "en", "v1", 1, 5)}
    assert sorted(p.name for p in (tmp_path / "ledger" / "batches" / "batch=b").iterdir() if not p.name.startswith(".")) == ["digest", "sums"]


def test_counts_of_a_vocabulary(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = [("a", "en", "Hello tokens, unlikelyish words 123"), ("a", "en", None), ("b", None, "été " * 30)]
    docs = spark.createDataFrame([(s, lang, t, -1) for s, lang, t in rows], "source string, lang string, text string, tokens int")
    got = Counter((r["source"], r["lang"], r["tokens"]) for r in encoder_counts(docs, path, "word-bpe").collect())
    assert got == Counter((s, lang, len(own.encode(t or "", add_special_tokens=False).ids)) for s, lang, t in rows)
    assert encoder_counts(docs, path, "word-bpe").agg(F.countDistinct("tokenizer")).first()[0] == 1
