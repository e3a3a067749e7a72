"""Exact links and top-k of pruned vector joins against brute force, the share of pairs they score, and the measured recall."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from civictext.operators import similarity as S
from civictext.operators import vector_join as V


def frame(spark, x, kind="double"):
    return spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], f"id long, embedding array<{kind}>").repartition(3)


def unit(x):
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def clustered(n, d=24, clusters=30, spread=0.25, seed=1):
    rng = np.random.default_rng(seed)
    return unit(unit(rng.normal(size=(clusters, d)))[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, d)) / np.sqrt(d))


def sparse(n, d=60, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.poisson(0.4, size=(n, d)) * (rng.random((n, d)) < rng.random((n, 1)))
    x[:20] = x[0]
    x[20:23] = 0
    return unit(x.astype(float))


TABLES = {"clustered": clustered(400), "sparse": sparse(400), "unequal": clustered(300) * np.random.default_rng(5).lognormal(size=(300, 1)),
          "isotropic": unit(np.random.default_rng(3).normal(size=(300, 16))), "zeros": np.zeros((5, 4))}


def brute_links(x, t):
    score = np.round(x @ x.T, 12)
    _, first, inverse = np.unique(x, axis=0, return_index=True, return_inverse=True)
    rep = np.array([np.flatnonzero(inverse == g).min() for g in range(len(first))])[inverse.reshape(-1)]
    own = [(int(rep[i]), i) for i in range(len(x)) if rep[i] != i and round(float(x[i] @ x[i]), 4) >= t]
    return sorted([(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if rep[i] == i and rep[j] == j and score[i, j] >= t] + own)


@pytest.mark.parametrize("name", list(TABLES))
def test_links_equal_brute_force(spark, name):
    x = TABLES[name]
    for t, sizes in ((0.9 if name != "isotropic" else 0.6, {"block_rows": 50, "pivot_rows": 20}), (0.6, {}))[:2 if name == "sparse" else 1]:
        got = V.links(frame(spark, x), "id", "embedding", t, **sizes).collect()
        assert sorted((r.id1, r.id2) for r in got) == brute_links(x, t), (name, t)
        assert all(abs(r.score - x[r.id1] @ x[r.id2]) < 6e-5 for r in got)


@pytest.mark.parametrize("name", list(TABLES))
def test_top_k_equals_brute_force(spark, name):
    x = TABLES[name]
    df = frame(spark, x)
    q = df.select(F.col("id").alias("query_id"), "embedding").where("id % 3 = 0")
    score = np.round(x @ x.T, 12)
    for k, t, sizes in ((5, None, {"block_rows": 40, "pivot_rows": 20}), (3, 0.7, {"pivot_rows": 50}))[:2 if name == "sparse" else 1]:
        got = {}
        for r in V.top_k(df, q, k, t, **sizes).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
        for i in range(0, len(x), 3):
            best = sorted(range(len(x)), key=lambda j: (-score[i, j], j))[:k]
            assert got.get(i, []) == [j for j in best if t is None or score[i, j] >= t], (name, i)


def test_search_with_a_large_query_side_is_pruned(spark):
    x = clustered(300)
    df = frame(spark, x)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    small = S.search(df, q, k=4, threshold=0.5)
    large = S.search(df, q, k=4, threshold=0.5, max_chunk_bytes=1000, block_rows=64)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))
    empty = df.limit(0)
    assert S.search(empty, q, max_chunk_bytes=1000).count() == 0 and S.near_duplicates(empty).count() == 0


def test_few_pairs_are_scored_on_clustered_vectors(spark):
    x = clustered(6_000, d=48, clusters=60)
    df = frame(spark, x)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    report, both = {}, {}
    V.top_k(df, q, 10, pivot_rows=100, report=report).count()
    V.links(df, "id", "embedding", 0.95, pivot_rows=100, report=both).count()
    assert report["pairs"] == 36_000_000 and 0 < report["scored"] < report["pairs"] / 4, report
    assert both["scored"] < both["pairs"] / 4, both


@pytest.mark.parametrize("name", ["clustered", "isotropic"])
def test_adaptive_cells_reach_their_recall(spark, name):
    x = clustered(2_000, d=32) if name == "clustered" else unit(np.random.default_rng(8).normal(size=(2_000, 32)))
    df = frame(spark, x)
    q = df.select(F.col("id").alias("query_id"), "embedding")
    cells, centroids = S.build_ivf(df)
    got = {}
    for r in S.ivf_search(cells, centroids, q, k=10, threshold=None).collect():
        got.setdefault(r.query_id, set()).add(r.id)
    score = np.round(x @ x.T, 12)
    hit = sum(len(got[i] & set(sorted(range(len(x)), key=lambda j: (-score[i, j], j))[:10])) for i in range(0, len(x), 10))
    assert hit >= 0.9 * 10 * len(range(0, len(x), 10)), (name, hit)


def test_packed_vectors_are_exact():
    x = np.random.default_rng(1).normal(size=(50, 30)) * (np.random.default_rng(2).random((50, 30)) < 0.3)
    x[0], x[1] = 0, 1.5
    import pyarrow as pa
    blobs = V.pack(x)
    assert (V.unpack(pa.array(blobs, pa.binary()), 30) == x).all() and max(map(len, blobs)) <= 8 + 30 * 8 and len(blobs[0]) == 8


def test_a_row_is_sent_once_to_a_shard(spark, monkeypatch):
    """Vectors without clusters visit every cell; what is sent follows the blocks, not the cells."""
    x = unit(np.random.default_rng(4).normal(size=(3_000, 16)))
    df = frame(spark, x)
    sent = []
    blocks = V.score_blocks
    monkeypatch.setattr(V, "score_blocks", lambda placed, probes, *a, **b: sent.append(probes.count()) or blocks(placed, probes, *a, **b))
    monkeypatch.setattr(V, "CELL_ROWS", 20)
    assert V.links(df, "id", "embedding", 0.3, block_rows=1_000, pivot_rows=100).count() > 0
    V.top_k(df, df.select(F.col("id").alias("query_id"), "embedding"), 5, 0.1, block_rows=1_000, pivot_rows=100).count()
    assert max(sent) <= 3_000 * 2 * 3 and sent[0] <= 3_000 * 6, sent


def test_packed_forms_are_short_and_exact():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    counts = rng.poisson(0.8, size=(40, 384)).astype(float)
    few = counts / np.linalg.norm(counts, axis=1, keepdims=True)  # few distinct weights: a byte each
    floats = rng.normal(size=(40, 64)).astype(np.float32).astype(float)
    odd = np.array([[0.0, 1e300, -1e-300, 0.1], [np.nan, np.inf, 0.0, 0.0], [0.0, 0.0, 0.0, 0.1]])
    for x, most in ((few, 8 + 384 + 8 * 12), (floats, 8 + 4 * 64), (odd, 40)):
        blobs = V.pack(x)
        assert np.array_equal(V.unpack(pa.array(blobs, pa.binary()), x.shape[1]), x, equal_nan=True) and max(map(len, blobs)) <= most


def weighted_tables(spark, x):
    from civictext.operators import vectors as VEC
    df = frame(spark, x)
    return VEC.idf_weighted(df), VEC.idf_weighted(V.compact(df, "id", "embedding", x.shape[1]))


def test_blocks_hold_each_vector_once_and_pairs_are_not_shuffled(spark, monkeypatch):
    """What the join writes follows the rows: no vector is copied to the blocks that it is compared with."""
    x = unit(np.random.default_rng(4).normal(size=(1_200, 16)))
    x[100:400] = x[5]  # a hot vector
    held = []
    blocks = V._blocks
    monkeypatch.setattr(V, "_blocks", lambda *a: held.append(blocks(*a)) or held[0])
    got = V.links(frame(spark, x), "id", "embedding", 0.5, block_rows=100, pivot_rows=100)
    read = [V._block_read(pa.py_buffer(r.data), 16, None) for r in held[0].collect()]
    assert len(read) > 8 and sorted(np.concatenate([r[0] for r in read]).tolist()) == [i for i in range(1_200) if not 100 <= i < 400]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Aggregate" not in plan, plan
    assert sorted((r.id1, r.id2) for r in got.collect()) == brute_links(x, 0.5)


def test_weights_beside_packed_vectors_give_the_same_links(spark):
    x = TABLES["sparse"].copy()
    x[:, 0] = np.where(x.any(axis=1), 0.1, 0.0) + x[:, 0]
    dense, short = weighted_tables(spark, x)
    assert short.schema["embedding"].dataType.typeName() == "binary"
    width, weights = V.vectors_of(short, "embedding")
    both = {r.id: r.embedding for r in dense.collect()}
    for r in short.collect():
        assert V.weigh(V.unpack(pa.array([r.embedding], pa.binary()), width), weights)[0].tolist() == list(both[r.id])
    want, got = (sorted(map(tuple, V.links(d, "id", "embedding", 0.6, block_rows=50, pivot_rows=20).collect())) for d in (dense, short))
    assert got == want and len(want) > 50


def test_scores_are_rounded_as_spark_does(spark):
    score = np.round(np.array([0.00005, -0.00005, 0.12345, 0.123449999999, 0.99995, 1.0, -0.87655, 123.45675, 20_000.00005, 0.0]), 12)
    want = [r[0] for r in spark.createDataFrame([(float(s),) for s in score], "s double").select(F.round("s", 4)).collect()]
    assert V.four_places(score).tolist() == want


def test_single_precision_rules_out_no_link():
    rng = np.random.default_rng(6)
    x = unit(np.abs(rng.normal(size=(300, 40))))
    for scale in (1.0, 1e-3, 1e20):
        y = x * scale
        exact = np.round(y @ y.T, 12)
        t = float(np.quantile(exact, 0.9995))  # a product of the table itself
        for many in (0.0, 0.5):
            V_many, V.MANY = V.MANY, many
            try:
                found = {(int(i), int(j)) for a in V._reaching(y, y, t) for i, j in zip(*a[:2])}
            finally:
                V.MANY = V_many
            assert {(i, j) for i, j in zip(*np.nonzero(exact > t * (1 + 1e-9) + 1e-11))} <= found <= {(i, j) for i, j in zip(*np.nonzero(exact >= t * (1 - 1e-9) - 1e-11))}


def test_nearest_rows_far_from_zero_and_among_equal_distances(spark):
    """Distances are first taken from products, which lose digits far from zero; the result is that of the exact ones."""
    rng = np.random.default_rng(9)
    for x in (rng.normal(size=(300, 3)) * 1e-2 + 5_000, rng.integers(0, 4, size=(300, 3)).astype(float)):
        df = frame(spark, x)
        q = df.select(F.col("id").alias("query_id"), "embedding").where("id % 5 = 0")
        d = np.round(V.distances(x, x), 12)
        got = {}
        for r in V.top_k(df, q, 6, None, block_rows=60, pivot_rows=30, l2=True).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, -r.score))
        for i in range(0, 300, 5):
            assert got[i] == [(j, d[i, j]) for j in sorted(range(300), key=lambda j: (d[i, j], j))[:6]], i


def test_rows_written_alike_are_read_in_one_step():
    x = np.random.default_rng(2).normal(size=(30, 5))
    for y in (x, x.astype(np.float32).astype(float)):
        column = pa.array([b"other"] + V.pack(y), pa.binary()).slice(1)
        assert V._unpacked_alike(column, 5).tolist() == y.tolist() == V.unpack(column, 5).tolist() and V.unpack(column.slice(7, 4), 5).tolist() == y[7:11].tolist()
    mixed = np.vstack([x, x.astype(np.float32).astype(float), np.zeros((1, 5))])
    assert V._unpacked_alike(pa.array(V.pack(mixed), pa.binary()), 5) is None and V.unpack(pa.array(V.pack(mixed), pa.binary()), 5).tolist() == mixed.tolist()
