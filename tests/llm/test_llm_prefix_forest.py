"""The hash-prefix forest against brute force: recall, exact scores, ties, equal vectors, edge rows."""

import numpy as np

from llm import prefix_forest as P
from llm.queries import QUERIES


def brute(rows, queries, k):
    out = {}
    for q, v in queries:
        s = [(-float((np.float64(v) * np.float64(x)).sum()), i) for i, x in rows if i != q]
        out[q] = [(i, -t) for t, i in sorted(s)[:k]]
    return out


def run(spark, rows, queries, k, **more):
    schema = "vec_id long, embedding array<float>, score string, rank string, id string"
    frame = lambda x: spark.createDataFrame([(i, None if v is None else [float(y) for y in v], "a", "b", "c") for i, v in x], schema)
    out = {}
    for r in P.search(frame(rows).repartition(3), frame(queries), k, **more).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.id, r.score))
    return out


def recall(got, exp):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in e}) for q, e in exp.items()) / sum(map(len, exp.values()))


def check_scores(got, rows):
    own = {i: np.float64(np.float32(v)) for i, v in rows}
    for q, hits in got.items():
        for i, s in hits:
            assert abs(s - float(own[q] @ own[i])) < 1e-12 and i != q
        assert hits == sorted(hits, key=lambda x: (-x[1], x[0])) and len({i for i, _ in hits}) == len(hits)


def test_recall_on_random_clustered_and_unequal_vectors(spark):
    rng = np.random.default_rng(3)
    isotropic = rng.normal(size=(800, 64))
    clustered = rng.normal(size=(20, 64))[rng.integers(0, 20, 800)] * 3 + rng.normal(size=(800, 64))
    unequal = isotropic * rng.lognormal(size=(800, 1))
    for x in (isotropic, clustered, unequal):
        rows = [(i, np.float32(v)) for i, v in enumerate(x)]
        exp = brute(rows, rows[::20], 20)
        for more in ({}, {"block": 200, "sample_rows": 200}):  # buckets, salted blocks, a small sample
            got = run(spark, rows, rows[::20], 20, **more)
            check_scores(got, rows)
            assert recall(got, exp) >= 0.9, (recall(got, exp), more)


def test_equal_vectors_and_ties(spark):
    rng = np.random.default_rng(5)
    base = np.float32(rng.normal(size=(30, 8)))
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(400)] + [(900 + i, -base[1]) for i in range(5)]
    queries = [rows[0], rows[1], rows[35]]
    got = run(spark, rows, queries, 20, block=50)
    check_scores(got, rows)
    assert [i for i, _ in got[0]][:20] == list(range(100, 120))
    assert [i for i, _ in got[rows[35][0]]] == [0] + [i for i in range(100, 120) if i != rows[35][0]][:19]


def test_edge_rows(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [1.0]), (6, []), (None, [1.0, 2.0])]
    rows = bad + [(10, [1.0, 0.0]), (11, [0.5, 0.5]), (11, [0.5, 0.5]), (12, [0.0, -2.0])]
    got = run(spark, rows, rows, 20)
    assert {q: [i for i, _ in h] for q, h in got.items()} == {10: [11, 12], 11: [10, 12], 12: [10, 11]}  # all candidates, if fewer
    with_null = spark.createDataFrame([(1, [1.0, None]), (2, [1.0, 1.0]), (3, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.id) for r in P.search(with_null, with_null, 5).collect()) == [(2, 3), (3, 2)]
    assert run(spark, [], [], 20) == {} and run(spark, rows, [], 20) == {} and run(spark, bad, bad, 20) == {}


def test_query_recall(spark):
    for sf in ("sf0.001", "sf0.1"):
        table = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
        rows = [(r.vec_id, np.float32(r.embedding)) for r in table]
        queries = [r for r in rows if r[0] % 20 == 0]
        got = {}
        for r in QUERIES["op11_prefix_forest"](spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        check_scores(got, rows)
        assert recall(got, brute(rows, queries, 20)) >= 0.9 and all(len(h) == 20 for h in got.values()) and len(got) == len(queries)
