"""Top-k search, near duplicates and verdicts against brute force on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from civictext.operators import similarity as S


def unit(v):
    v = np.asarray(v, dtype=float)
    return (v / np.linalg.norm(v)).tolist()


def fixture_vectors(spark, n=60, d=8, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, d))
    base[10:17] = base[10]  # a cluster of 7 equal vectors
    rows = [(i, unit(base[i])) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>"), np.array([r[1] for r in rows])


def brute_topk(M, Q, k, t):
    out = {}
    for qi in range(len(Q)):
        s = M @ Q[qi]
        order = sorted(range(len(M)), key=lambda j: (-s[j], j))[:k]
        out[qi] = [(j, round(float(s[j]), 4)) for j in order if s[j] >= t]
    return out


def test_search_equals_brute_force(spark):
    df, M = fixture_vectors(spark)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    for chunk in (S.DEFAULT_CHUNK_BYTES, 200):  # broadcast path, then the salted block path
        got = S.search(df, q, k=5, threshold=0.1, index_key="id", max_chunk_bytes=chunk, block_rows=7).collect()
        exp = brute_topk(M, M, 5, 0.1)
        by_q = {}
        for r in got:
            by_q.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
        for qi, hits in exp.items():
            mine = [(j, s) for _, j, s in sorted(by_q.get(qi, []))]
            assert mine == hits, (qi, mine, hits)


def brute_links(M, t):
    """Pairs between the smallest ids of equal vectors, and each copy linked to its class."""
    rep = [min(j for j in range(len(M)) if (M[j] == M[i]).all()) for i in range(len(M))]
    pairs = [(i, j) for i in range(len(M)) for j in range(i + 1, len(M)) if rep[i] == i and rep[j] == j and M[i] @ M[j] >= t]
    return sorted(pairs + [(rep[i], i) for i in range(len(M)) if rep[i] != i])


def test_near_duplicates_are_complete(spark):
    df, M = fixture_vectors(spark)
    for t in (0.95, 0.6):
        for block in (S.DEFAULT_BLOCK_ROWS, 9):  # one block, then several cells pruned by their radius
            got = sorted((r.id1, r.id2) for r in S.near_duplicates(df, "id", threshold=t, block_rows=block).collect())
            assert got == brute_links(M, t), (t, block)


def test_thresholds_are_met_exactly(spark):
    # vector pairs just above and just below each threshold
    rows, exp = [], []
    for k, t in enumerate((0.95, 0.75)):
        for m, eps in enumerate((1e-9, -1e-9)):
            c = t + eps
            base = 10 * (2 * k + m)
            v = np.zeros((2, 16))
            v[0, 4 * k + 2 * m] = 1.0
            v[1, 4 * k + 2 * m], v[1, 4 * k + 2 * m + 1] = c, np.sqrt(1 - c * c)
            rows += [(base, v[0].tolist()), (base + 1, v[1].tolist())]
            exp.append((base, t, eps > 0))
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    for base, t, linked in exp:
        got = {(r.id1, r.id2) for r in S.near_duplicates(df, "id", threshold=t).collect()}
        assert ((base, base + 1) in got) == linked


def test_kernels_stay_in_memory(spark):
    """50,000 queries against 50,000 rows: the kernel's own memory stays far below one score matrix (20 GB)."""
    import tracemalloc

    rng = np.random.default_rng(1)
    Q, B = rng.normal(size=(50_000, 8)), rng.normal(size=(50_000, 8))
    Q, B = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (Q, B))
    ids = np.arange(len(B))
    tracemalloc.start()
    some = {}
    for qi, bi, sc in S._tiled_topk(Q[:4_000], B, ids, 5, None):
        for q, b, s in zip(qi.tolist(), bi.tolist(), sc.tolist()):
            if q % 400 == 0:
                some.setdefault(q, []).append((b, s))
    near = S._nearest_cells(Q, B[:500], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400 << 20, peak
    for q, hits in some.items():
        s = np.round(B @ Q[q], S.SCORE_DECIMALS)
        assert sorted(b for b, _ in hits) == sorted(sorted(range(len(B)), key=lambda j: (-s[j], j))[:5])
    for q in range(0, 50_000, 5_000):
        d = ((B[:500] - Q[q]) ** 2).sum(axis=1)
        assert near[q].tolist() == np.argsort(d, kind="stable")[:10].tolist()


def test_verdict_rules(spark):
    hits = [  # query, id, rounded score, rank
        (2, 1, 0.91, 1),
        (3, 1, 0.90, 1),
        (4, 1, 0.86, 1), (4, 2, 0.86, 2), (4, 3, 0.86, 3),
        (5, 1, 0.85, 1), (5, 2, 0.85, 2), (5, 3, 0.85, 3),
        (6, 1, 0.89, 1), (6, 2, 0.89, 2),
    ]
    h = spark.createDataFrame(hits, "q long, id long, score double, rank int")
    queries = spark.createDataFrame([(i,) for i in range(1, 7)], "q long")
    got = {r.q: r for r in S.verdicts(queries, h, "q", "id").collect()}
    assert (got[1].is_suspicious, got[1].confidence, got[1].num_similar, got[1].reason) == \
        (False, 0.0, 0, "No similar articles found")
    assert got[2].is_suspicious and not got[3].is_suspicious
    assert got[4].is_suspicious and not got[5].is_suspicious and not got[6].is_suspicious
    assert [(h.id, h.score) for h in got[4].similar] == [(1, 0.86), (2, 0.86), (3, 0.86)] and got[1].similar == []


def test_ivf_search_recall_and_exhaustive_probe(spark):
    df, M = fixture_vectors(spark, n=400, d=8)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    exact = {(r.query_id, r.id, r.score) for r in S.search(df, q, k=5, threshold=None, index_key="id").collect()}
    cells, cents = S.build_ivf(df, key="id", nlist=10)
    approx = {(r.query_id, r.id, r.score) for r in S.ivf_search(cells, cents, q, k=5, threshold=None, nprobe=4,
                                                                 index_key="id").collect()}
    assert len(approx & exact) / len(exact) > 0.6
    full = {(r.query_id, r.id, r.score) for r in S.ivf_search(cells, cents, q, k=5, threshold=None,
                                                               nprobe=len(cents), index_key="id",
                                                               max_chunk_bytes=2000, block_rows=11).collect()}
    assert full == exact  # probing every cell is exhaustive


def test_ivf_near_duplicates_blocks_equal_exact(spark):
    df, M = fixture_vectors(spark, n=300, d=8)
    q = df.select(F.col("id").alias("_q"), F.col("embedding").alias("_v"))
    hits = S.search(df, q, k=5, threshold=0.8, index_key="id", query_key="_q", query_vec="_v", round_to=4)
    exact = sorted((r["_q"], r["id"], r["score"]) for r in hits.where("id > _q").collect())  # each row's five best
    # tiny blocks force several index and query salts per cell (the hot-cell path)
    ivf = sorted(tuple(r) for r in S.ivf_near_duplicates(df, "id", threshold=0.8, neighbours=5, nlist=6, nprobe=6,
                                                         block_rows=7).collect())
    assert ivf == exact and len(exact) > 0


def test_ivf_near_duplicates_have_no_neighbour_cut(spark):
    _, M = fixture_vectors(spark, n=300, d=8)
    M = np.vstack([M, np.repeat(M[:1], 12, axis=0)])  # row 0 and 12 copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(M)], "id int, embedding array<double>")
    t = 0.5
    got = [(r.id1, r.id2) for r in S.ivf_near_duplicates(df, "id", threshold=t, nlist=12, nprobe=8, block_rows=20).collect()]
    assert len(got) == len(set(got)) and {(0, i) for i in range(300, 312)} <= set(got)
    brute = set(brute_links(M, t))
    assert set(got) <= brute and len(set(got)) >= 0.9 * len(brute) and len(brute) > 5 * 300
    full = sorted(tuple(r) for r in S.ivf_near_duplicates(df, "id", threshold=t, nlist=12, nprobe=12, block_rows=20).collect())
    assert full == sorted(tuple(r) for r in S.near_duplicates(df, "id", threshold=t).collect())
    assert S.ivf_near_duplicates(df.limit(0), "id", threshold=t).count() == 0


def test_many_cells_are_fitted_in_rounds_of_few_rows(spark, monkeypatch):
    df, M = fixture_vectors(spark, n=400, d=8)
    monkeypatch.setattr(S, "LOCAL_STATISTICS", 1)
    cells, cents = S.build_ivf(df, key="id", nlist=12)
    got = {r.id: r.cell for r in cells.collect()}
    near = ((M[:, None] - cents[None]) ** 2).sum(-1)
    assert cents.shape == (12, 8) and len(got) == 400 and all(near[i, c] <= near[i].min() + 1e-9 for i, c in got.items())
    for c in set(got.values()):  # rounds have come to rest or are near it
        assert np.abs(M[[i for i in got if got[i] == c]].mean(axis=0) - cents[c]).max() < 0.1
    full = sorted(tuple(r) for r in S.ivf_near_duplicates(df, "id", threshold=0.5, nlist=12, nprobe=12, block_rows=20).collect())
    assert full == sorted(tuple(r) for r in S.near_duplicates(df, "id", threshold=0.5).collect())


def test_document_links_keep_neither_texts_nor_long_vectors(spark, monkeypatch):
    """The near-duplicate query writes its vectors packed, without the texts."""
    from civictext.operators import vector_join as VJ
    from civictext.operators import vectors as VEC
    from civictext.plans import vector_queries as Q
    texts = [(i, f"report {i % 3} of the water main in street {i % 5} " * 4 + "closed " * (i // 15)) for i in range(40)]
    docs = VEC.hashed_embedding("clean_text")
    monkeypatch.setattr(Q, "document_vectors", lambda spark, d, **k: spark.createDataFrame(texts, "doc_id long, clean_text string").withColumn("embedding", docs))
    tables = []
    keep = VJ.checkpoint_table
    monkeypatch.setattr(VJ, "checkpoint_table", lambda s, df, name: tables.append((name, df.schema)) or keep(s, df, name))
    got = sorted((r.id1, r.id2, r.score) for r in Q.document_near_duplicates(spark, "unused").collect())
    assert tables[0][0] == "compact-vectors" and not any("array" in f.dataType.simpleString() or f.name == "clean_text" for _, schema in tables for f in schema)
    plain = spark.createDataFrame(texts, "doc_id long, clean_text string").select("doc_id", docs.alias("embedding"))
    assert got == sorted(map(tuple, S.near_duplicates(plain, key="doc_id").collect())) and len(got) > 10
