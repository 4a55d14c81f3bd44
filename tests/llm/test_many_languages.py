"""Languages beyond the 64 of one word of a bitmask are learned and predicted like all others."""

import numpy as np

from codeweft.llm.langid import identify, train


def test_more_languages_than_a_word_has_bits(spark):
    many = 131
    rng = np.random.default_rng(7)
    syllables = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(3 * many)]
    text = lambda k: " ".join("".join(rng.choice(syllables[3 * k : 3 * k + 3], 2)) for _ in range(30))
    name = lambda k: f"l{k:03}"
    # later languages have fewer documents, so that they come last
    rows = [(1000 * k + i, text(k), name(k)) for k in range(many) for i in range(12 - 4 * (k > 63) - 2 * (k > 127))]
    model = train(spark.createDataFrame(rows, "id long, text string, lang string"))
    assert sorted(model.languages) == [name(k) for k in range(many)] and model.rows.shape[0] == 3
    asked = spark.createDataFrame([(k, text(k), name(k)) for k in range(many)], "doc_id long, text string, lang string")
    found = identify(asked, model, ["doc_id", "lang"]).collect()
    assert len(found) == many and [r for r in found if r["lang_pred"] != r["lang"]] == []
    # the same scores as of one language's filter at a time
    some = [t.encode() for t in (text(3), text(70), text(130))]
    assert model.scores(some).argmax(axis=1).tolist() == [model.languages.index(name(k)) for k in (3, 70, 130)]
