"""Near duplicates of texts and vectors, and components, against brute force."""

from collections import Counter

import numpy as np
import pytest

from codeweft.llm.components import components, roots
from codeweft.llm.embeddings import embedding_duplicates
from codeweft.llm.minhash import BANDS, ROWS, WordHashes, estimated_jaccard, near_duplicates, shingle_set, sketch, without_duplicates


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    want = roots([(a, b) for a, b in pairs if a != b])
    links = spark.createDataFrame(pairs, "a long, b long")
    for one_task in (10**6, 0):
        assert {r["node"]: r["component"] for r in components(links, one_task).collect()} == want
    assert components(links.limit(0)).count() == 0


def brute(rows, width, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    by_id = {}
    links = []
    for k, (i, _) in enumerate(rows):
        if i is None:
            continue
        if i in by_id:
            links.append((k, by_id[i]))
        by_id.setdefault(i, k)
        for m in range(k):
            if rows[m][0] is not None and sets[k] and sets[m] and 100 * len(sets[k] & sets[m]) >= percent * len(sets[k] | sets[m]):
                links.append((m, k))
    group = roots(links)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = group.get(k, k)
            least[r] = min(least.get(r, i), i)
    return Counter((i, len(sets[k]), None if i is None else least[group.get(k, k)]) for k, (i, _) in enumerate(rows))


def corpus():
    rng = np.random.default_rng(9)
    words = [f"t{i}" for i in range(3000)]
    rows, i = [], 0
    for _ in range(25):
        base = list(rng.choice(words, rng.integers(5, 120)))
        for edits in (0, 0, 1, 2, 4, 8):
            own = list(base)
            for p in rng.integers(0, len(own), edits):
                own[p] = str(rng.choice(words))
            rows.append((i, " ".join(own)))
            i += 1
    chain = list(rng.choice(words, 60))
    for step in range(8):  # neighbours are near, ends aren't
        rows.append((i, " ".join(chain[step : step + 50])))
        i += 1
    long = list(rng.choice(words, 3000))
    rows += [(i, " ".join(long)), (i + 1, " ".join(long[:2900])), (i + 2, " ".join(long[:1100])), (i + 3, " ".join(long[:1000])), (i + 4, " ".join(long[1500:]))]
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "one two"), (None, "one two"), (907, "a b c"), (907, "quite another text"), (3, "and a third one with the id three")]
    return [(None if a is None else int(a), b) for a, b in rows]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, width):
    rows = corpus()
    table = spark.createDataFrame([(a, b, 1, 2, 3) for a, b in rows], "doc_id long, text string, n long, rep long, component_id long")
    found = near_duplicates(table, width).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute(rows, width)
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"]) for r in found)
    if width == 5:
        left = without_duplicates(table)
        assert left.columns == table.columns
        kept = {i for i, _, c in brute(rows, 5) if i is not None and i == c}
        assert Counter(r["doc_id"] for r in left.collect()) == Counter({i: 1 for i in kept} | {None: 1})
        assert near_duplicates(table.limit(0)).count() == 0


def test_estimates():
    rng = np.random.default_rng(4)
    memo = WordHashes()
    for n in (40, 200, 5000):
        words = [f"x{i}" for i in rng.integers(0, 10**6, n)]
        a = shingle_set(" ".join(words), 1, memo)
        b = shingle_set(" ".join(words[: int(n * 0.8)]), 1, memo)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = estimated_jaccard(sketch(a)[None], sketch(b)[None], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(got - true) < 0.12


def test_bands_of_sets_of_all_sizes():
    """Pairs at the threshold share a band, whether most buckets are empty or none is."""
    rng = np.random.default_rng(8)
    for n in (5, 9, 30, 150, 700, 3000):
        for _ in range(60):
            h = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64, endpoint=False))
            c = -(-len(h) * 4 // 5)
            d = (len(h) - c) // 2
            order = rng.permutation(len(h))
            a, b = sketch(np.sort(h[order[: c + d]])), sketch(np.sort(np.concatenate([h[order[:c]], h[order[c + d :]]])))
            assert (a == b).reshape(BANDS, ROWS).all(axis=1).any(), n


def test_embedding_duplicates(spark):
    rng = np.random.default_rng(6)
    rows, i = [], 0
    for label in ("1", "2", None):
        for _ in range(40):
            v = rng.normal(size=24)
            for noise in (0, 0, 0.05, 0.1, 0.6):
                rows.append((i, (v + noise * rng.normal(size=24)).astype("float32").tolist(), label))
                i += 1
    near = rng.normal(size=24)
    rows += [(i + k, (near + 0.02 * rng.normal(size=24)).astype("float32").tolist(), "1") for k in range(60)]
    rows += [(5000, None, "1"), (5001, [0.0] * 24, "1"), (5002, [float("nan")] * 24, "1"), (5003, [None] + [1.0] * 23, "2"), (5004, [float("inf")] + [1.0] * 23, "2"), (5005, [], "2"), (None, rows[0][1], "1"), (5006, [2 * x for x in rows[0][1]], "1")]
    good = [(i, np.array(v, dtype=float) / np.linalg.norm(v), lab) for i, v, lab in rows if i is not None and lab and v and None not in v and np.isfinite(v).all() and any(v)]
    links = [(a[0], b[0]) for k, a in enumerate(good) for b in good[:k] if a[2] == b[2] and float(a[1] @ b[1]) >= 0.93]
    group, degree = roots(links), Counter(x for p in links for x in p)
    table = spark.createDataFrame([(a, b, c, 1, 2) for a, b, c in rows], "vec_id long, embedding array<float>, label string, n_links long, rep long")
    found = embedding_duplicates(table).collect()
    assert len(found) == len(rows)
    for r in found:
        i = r["vec_id"]
        assert (r["n_links"], r["component_id"]) == (degree[i], group.get(i, i)), i
    assert embedding_duplicates(table.limit(0)).count() == 0
