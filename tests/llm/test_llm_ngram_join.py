"""PartEnum join against all pairs."""

import itertools
import re

import numpy as np
import pytest
from edge_rows import documents, empty

from llm import ngram_join as J


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    """``{id: (size, component, links)}`` by all pairs."""
    sets = [(d, shingles(t, k)) for d, t in rows]
    root, links = {d: d for d, _ in rows}, dict.fromkeys((d for d, _ in rows), 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(sets, 2):
        both = len(s & t)
        if s and den * both >= num * (len(s) + len(t) - both):
            links[a] += 1
            links[b] += 1
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return {d: (len(s), find(d), links[d]) for d, s in sets}


def mutated(rng, n_groups=25, words=None):
    """Groups of texts with graded similarity, exact copies and a shared passage."""
    vocabulary = [f"w{i}" for i in range(words or 4000)]
    passage = rng.choice(vocabulary, 40).tolist()
    rows = []
    for g in range(n_groups):
        base = rng.choice(vocabulary, int(rng.integers(1, 260))).tolist()
        if g % 3 == 0:
            base[len(base) // 2:len(base) // 2] = passage
        for v in range(int(rng.integers(1, 9))):
            text = list(base)
            for _ in range(int(rng.integers(0, 1 + len(text) // 12))):
                text[int(rng.integers(0, len(text)))] = vocabulary[int(rng.integers(0, len(vocabulary)))]
            rows.append((len(rows), " ".join(text)))
    return rows


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5), (2, 1, 2), (1, 1, 1)])
def test_classes_equal_all_pairs(spark, k, num, den):
    rows = mutated(np.random.default_rng(k))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), k, num, den).collect()}
    assert got == brute(rows, k, num, den)


def test_blocks_of_large_groups_change_nothing(spark, monkeypatch):
    rows = mutated(np.random.default_rng(9), 6, 60)
    rows += [(len(rows) + i, t) for i, (_, t) in enumerate(rows)]
    want = brute(rows, 3, 4, 5)
    monkeypatch.setattr(J, "BLOCK_DOCS", 3)
    monkeypatch.setattr(J, "BUCKET_BLOCK", 2)
    monkeypatch.setattr(J, "PAIRS_UP_TO", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 4, 5).collect()}
    assert got == want


def test_similar_sets_always_share_a_signature():
    rng = np.random.default_rng(0)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        starts = J.band_starts(5000, num, den)
        for size in [*range(1, 60), 151, 300, 601, 1500]:
            items = rng.integers(0, 1 << 63, 2 * size + 2, dtype=np.uint64)
            shared = next(i for i in range(size, -1, -1) if i == 0 or den * (i - 1) < num * (2 * size - i + 1))
            for cut in {shared, min(size, shared + 1)}:
                if den * cut >= num * (2 * size - cut):
                    a, b = np.sort(items[:size]), np.sort(np.concatenate((items[:cut], items[size:2 * size - cut])))
                    assert np.intersect1d(J.signatures(a, starts, num, den), J.signatures(b, starts, num, den)).size, (num, den, size)


def test_sketches_never_rule_out_similar_sets():
    rng = np.random.default_rng(1)
    for size in (5, 64, 100, 500):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for drop in range(0, size // 10 + 1):
            a, b = base, base[drop:]
            both = len(b)
            words = [J.sketch(a), J.sketch(b)]
            if 10 * both >= 9 * (len(a) + len(b) - both):
                assert J.possible_links(np.array([len(a), len(b)]), words, np.zeros(2), False, 9, 10) == [(0, 1)]


def by_row(rows, k, num, den):
    """Sorted ``(id, size, smallest id of the class, links)`` of rows whose ids may repeat or be null."""
    judged = brute([(i, t) for i, (_, t) in enumerate(rows)], k, num, den)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[judged[i][1]] = min(d, least.get(judged[i][1], d))
    return sorted(((d, judged[i][0], least.get(judged[i][1]), judged[i][2]) for i, (d, _) in enumerate(rows)), key=str)


def test_rows_of_one_id_are_judged_by_their_own_text(spark):
    rng = np.random.default_rng(4)
    a, b = (" ".join(rng.choice([f"w{i}" for i in range(900)], 80)) for _ in range(2))
    near = a + " one"
    for rows in ([(1, b), (1, a), (2, near)], [(1, a), (1, b), (2, near)], [(None, a), (None, near), (3, b), (None, b), (3, b)], [(None, a), (None, a)], [(None, None)]):
        got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 9, 10)
        assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str) == by_row(rows, 3, 9, 10), rows


def test_edge_rows(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = J.jaccard_classes(docs, 3, 9, 10)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "n_links").collect()), key=str) == by_row(rows, 3, 9, 10)
    assert J.jaccard_classes(empty(spark), 3, 9, 10).count() == 0
    judged = brute([(i, t) for i, (_, t) in enumerate(rows)], 3, 9, 10)
    kept = J.keep_first(docs, 3, 9, 10)
    assert kept.columns == docs.columns and kept.count() == len({v[1] for v in judged.values()})
