"""Periodic runs against a brute-force scan of every period, and through pieces of a few words."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from edge_rows import documents, empty

from llm import periodic_runs as P
from llm.queries import ORACLE, QUERIES


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(w, least=12):
    """Runs ``(start, length, period)``: intervals of every period, the smallest period of equal stretches."""
    best, n = {}, len(w)
    a = np.unique(np.array(w, dtype=object).astype(str), return_inverse=True)[1] if n else np.zeros(0, int)
    for p in range(1, n // 2 + 1):
        same = np.concatenate(([False], a[:n - p] == a[p:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if e - s + p >= max(least, 2 * p):
                best.setdefault((s, e - s + p), p)
    return sorted((s, length, p) for (s, length), p in best.items())


def kept(w, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng):
    """Random words with repeated blocks inside repeated blocks."""
    out = []
    while len(out) < rng.choice((0, 5, 30, 200, 700)):
        block = [f"w{rng.randrange(rng.choice((1, 2, 3, 50)))}" for _ in range(rng.randint(1, rng.choice((3, 20, 90))))]
        if rng.random() < 0.3:
            block = block * 3 + ["x"]
        out += (block * rng.randint(1, 9))[:rng.randint(1, 400)]
    return out


def check(rows, texts):
    got = {r.doc_id: r for r in rows}
    for d, t in texts:
        w = words(t)
        exp = brute(w)
        assert [tuple(x) for x in got[d].runs] == exp, (d, len(w))
        assert got[d].n_words == len(w) and got[d].collapsed == kept(w, exp)


@pytest.mark.parametrize("tile", [P.TILE, 50])
def test_equals_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(P, "TILE", tile)  # 50: pieces of a few words, so that most runs are stitched
    rng = random.Random(tile)
    texts = [(i, "  ".join(random_words(rng))) for i in range(150)]
    texts += [(1000, "same " * 2500), (1001, "a b " * 900 + "c " + "a b " * 900), (1002, " ".join(random_words(rng) * 7))]
    fib = ["a", "b"]
    while len(fib[-1]) < 900:
        fib.append(fib[-1] + " " + fib[-2])  # Fibonacci words: as many runs as a text can have
    texts.append((1003, fib[-1]))
    check(P.find_runs(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect(), texts)


def test_long_periods_are_stitched_over_pieces(spark):
    rng = random.Random(4)
    block = [f"w{rng.randrange(9)}" for _ in range(15_000)]
    text = " ".join(["lead"] + block * 2 + block[:700] + ["tail"])
    row = P.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (1, 30_700, 15_000) in [tuple(r) for r in row.runs] and row.n_words == 30_702
    assert P.boundary_z(np.array([1, 1, 1, 1] * 10 + [2]), 6).tolist() == [41, 39, 38, 37, 36, 35]


def test_edge_rows(spark):
    rows = P.find_runs(documents(spark)).collect()
    docs = documents(spark).select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for r in rows:
        texts = {d.text for d in docs if d.doc_id == r.doc_id}
        assert (r.n_words, [tuple(x) for x in r.runs]) in [(len(words(t)), brute(words(t))) for t in texts if len(words(t)) < 5_000] or r.n_words > 5_000
    assert P.find_runs(empty(spark)).collect() == []
    assert set(P.find_runs(documents(spark)).columns) == {"doc_id", "n_words", "runs", "collapsed"}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs) and "op13_periodic_runs" in ORACLE
    planted = 0
    for d in docs:
        w, h = words(d.text), zlib.crc32(str(d.doc_id).encode())
        n, g = len(w), h // 10
        if n > 4_000:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs, r = brute(w), got[d.doc_id]
        planted += bool(runs) and h % 10 == 0
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        assert (r.n_runs, (r.start, r.length, r.period)) == (len(runs), best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert r.runs_sha256 == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)) and r.collapsed_sha256 == sha(kept(w, runs))
    assert planted > 5
