"""Context-tree weighting: base score, the recursion, and a proper distribution."""

import collections
import math
import re
import zlib
from functools import lru_cache

import numpy as np
from edge_rows import documents, empty

from llm import context_tree as C


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]


def plain_model(texts):
    """The same weighting written node by node; returns ``log10 P(text)``."""
    counts = collections.defaultdict(lambda: [0, 0])
    seen = collections.defaultdict(set)
    low = lambda t: re.sub(rb"[A-Z]", lambda m: m[0].lower(), t.encode())

    def steps(t):
        data = b"\xff" * C.DEPTH + low(t) + b"\xff"
        for i in range(C.DEPTH, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield [data[i - d:i] for d in range(C.DEPTH + 1)], node, bit
                node = node << 1 | bit

    for t in texts:
        for contexts, node, bit in steps(t):
            for d, c in enumerate(contexts):
                counts[c, node][bit] += 1
                if d:
                    seen[contexts[d - 1], node].add(c)

    own = lambda a, b: math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @lru_cache(None)
    def weighted(c, node):
        e = own(*counts[c, node]) if (c, node) in counts else 0.0
        if len(c) == C.DEPTH:
            return e
        return np.logaddexp(e, sum(weighted(x, node) for x in seen[c, node])) - math.log(2)

    def one(contexts, node, d=0):
        a, b = counts.get((contexts[d], node), (0, 0))
        p = (b + .5) / (a + b + 1)
        if d == C.DEPTH:
            return p
        e = own(a, b) if a + b else 0.0
        stop = math.exp(e - math.log(2) - weighted(contexts[d], node))
        return stop * p + (1 - stop) * one(contexts, node, d + 1)

    return lambda t: sum(math.log10(one(c, n) if bit else 1 - one(c, n)) for c, n, bit in steps(t))


def check(spark, rows):
    got = {r.doc_id: r for r in C.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    train = [t or "" for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2]
    c = collections.Counter(w for t in train for w in tokens(t))
    n, v, score = sum(c.values()), len(c), plain_model(train)
    for d, t in rows:
        w = tokens(t)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == (len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(got[d].base_score, sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w), rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(got[d].score, score(t or ""), rel_tol=1e-9), (d, t)
    assert any(r.held_out for r in got.values())


def test_scores_equal_the_plain_version(spark):
    check(spark, [(i, t) for i, t in enumerate(["abra cadabra", "ABRA", "", None, "Ünï code\nabra", "bra bra bra", "zz top", "cad", "abra cad abra", "dab", "x", "abracadabra zz"])])


def test_rare_words_go_through_the_join(spark, monkeypatch):
    monkeypatch.setattr(C, "HEAD_WORDS", 1)
    check(spark, [(i, " ".join(f"w{(i * j) % 9}" for j in range(12))) for i in range(20)])


def test_small_blocks_and_runs_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list("abc"), 3)) for _ in range(40))) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = {r.doc_id: r.score for r in C.score_texts(frame).collect()}
    monkeypatch.setattr(C, "BLOCK", 700)
    monkeypatch.setattr(C, "RUN", 10)
    got = {r.doc_id: r.score for r in C.score_texts(frame).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[d], want[d], rel_tol=1e-9) for d in want)


def test_byte_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    seen = np.unique(rng.integers(97, 101, (3000, 6)) @ (1 << 8 * np.arange(5, -1, -1)))
    counts = rng.integers(1, 50, len(seen))
    parts = [part for _, part, _ in C.deep_levels(seen, counts)]
    code, zero, one, weight = (np.concatenate(x) for x in zip(*parts))
    codes, at = np.unique(code, return_inverse=True)
    upper = C.upper_table(codes, *[np.bincount(at, x) for x in (zero, one, weight)])
    contexts = np.concatenate((np.unique(seen >> 8)[::97], [0, 0x6161616161, 0x6162000000]))
    every = np.unique(np.concatenate((seen, (contexts[:, None] << 8 | np.arange(256)).ravel())))
    n = np.zeros(len(every), np.int64)
    n[np.searchsorted(every, seen)] = counts
    chance = 10 ** C.gram_logs(every, n, upper)
    for c in contexts:
        assert math.isclose(chance[every >> 8 == c].sum(), 1, rel_tol=1e-9)


def test_learned_texts_cost_less_than_others(spark):
    """Texts that repeat words of their own: those that were learned are told apart by their code length."""
    rng = np.random.default_rng(2)
    own = lambda: ["".join(rng.choice(list("etaoinshrdlucmfw"), 7)) for _ in range(8)]
    rows = [(i, " ".join(own() * 8)) for i in range(80)]
    got = {r.doc_id: (r.held_out, -r.score / r.n_bytes) for r in C.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    held, learned = ([s for h, s in got.values() if h is side] for side in (True, False))
    assert held and max(learned) < min(held)


def test_places():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 50_000))
    wanted = np.random.default_rng(4).choice(keys, 200_000)
    assert (keys[C.Places(keys).of(wanted)] == wanted).all()


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 2.5, 10, 1e3, 1e7])
    assert np.allclose(C.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-9, atol=1e-9)


def test_edge_rows(spark):
    docs = documents(spark)
    rows = C.score_texts(docs).collect()
    assert len(rows) == docs.count() and all(r.score < 0 and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (0, 1, 2)} == {1}
    assert C.score_texts(empty(spark)).count() == 0
    lone = C.score_texts(spark.createDataFrame([(None, "ab")], "doc_id long, text string")).first()  # nothing to learn from
    assert (lone.train_tokens, lone.base_score, lone.n_known) == (0, 0.0, 0) and math.isclose(lone.score, -24 * math.log10(2), rel_tol=1e-5)
