"""Density clusters against a plain single-linkage version."""

import math

import numpy as np
from pyspark.sql import functions as F

from civictext.operators import density as D


def plain(x, mcs, k):
    """Labels by sorting all pairs, building the whole single-linkage tree and condensing it from the top."""
    n = len(x)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(dist + np.where(np.eye(n) > 0, -1, 0), axis=1)[:, k]
    w = np.maximum(np.maximum(dist, core[:, None]), core[None])
    edges = sorted((w[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    found, top = list(range(n)), list(range(n))
    kids, height, size = {}, {}, {i: 1 for i in range(n)}

    def find(v):
        while found[v] != v:
            found[v] = found[found[v]]
            v = found[v]
        return v

    node, total = n, 0.0
    for d, i, j in edges:
        a, b = find(i), find(j)
        if a != b:
            kids[node], height[node], size[node] = (top[a], top[b]), d, size[top[a]] + size[top[b]]
            total += d
            found[a] = b
            top[b] = node
            node += 1

    def parts(v):
        """What merges at the height of ``v``, all at once."""
        out = []
        for s in kids[v]:
            out += parts(s) if s in kids and height[s] == height[v] else [s]
        return out

    def leaves(v):
        stack, out = [v], []
        while stack:
            v = stack.pop()
            stack.extend(kids[v]) if v in kids else out.append(v)
        return out

    clusters = []  # [birth, rating, children, rows]

    def grow(v, birth):
        me = len(clusters)
        clusters.append([birth, 0.0, [], leaves(v)])
        while True:
            lam = 1 / max(height[v], D.LEAST)
            large = [s for s in parts(v) if size[s] >= mcs]
            if len(large) > 1:
                clusters[me][1] += size[v] * (lam - birth)
                for s in large:
                    clusters[me][2].append(grow(s, lam))
                return me
            clusters[me][1] += (size[v] - sum(size[s] for s in large)) * (lam - birth)
            if not large:
                return me
            v = large[0]

    grow(node - 1, 0.0)
    best = {}

    def rate(c):
        inside = sum(rate(s) for s in clusters[c][2])
        best[c] = c > 0 and (not clusters[c][2] or clusters[c][1] >= inside)
        return clusters[c][1] if best[c] else inside

    rate(0)
    label = [-1] * n

    def mark(c):
        if best[c]:
            for r in clusters[c][3]:
                label[r] = c
            return
        for s in clusters[c][2]:
            mark(s)

    mark(0)
    return label, total


def blobs(seed, n=300, noise=60, d=3):
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-10, 10, size=(6, d))
    parts = [c + rng.normal(size=(n // 6, d)) * rng.uniform(0.2, 1.2) for c in centres] + [rng.uniform(-14, 14, size=(noise, d))]
    return np.vstack(parts)


def test_equals_plain_version(spark, monkeypatch):
    mcs, k, sizes = 15, 5, {"block_rows": 100, "pivot_rows": 60}  # several cells and blocks
    x = np.round(blobs(1), 6)
    df = spark.createDataFrame([(i + 100, [float(v) for v in p]) for i, p in enumerate(x)], "row_id int, embedding array<double>").repartition(3)
    want, total = plain(x, mcs, k)
    made = []
    tree_of = D.spanning_tree
    monkeypatch.setattr(D, "spanning_tree", lambda *a: made.append(tree_of(*a)) or made[0])
    rows = D.density_clusters(df, min_cluster_size=mcs, min_samples=k, **sizes).collect()
    assert made[0].count() == len(x) - 1 and abs(made[0].agg(F.sum("w")).first()[0] - total) < 1e-6
    got = {r.row_id - 100: r.cluster for r in rows}
    pairs = {(got[i], want[i]) for i in range(len(x))}
    assert len(got) == len(x) and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}), sorted(pairs)
    assert all((a == -1) == (b == -1) for a, b in pairs) and len(pairs) > 4 and -1 in got.values()
    count = [sum(c == k for c in got.values()) for k in range(max(got.values()) + 1)]
    assert count == sorted(count, reverse=True) and min(count) >= mcs


def test_equal_rows_few_rows_and_one_blob(spark):
    two = [(i, [0.0, 0.0]) for i in range(20)] + [(20 + i, [5.0, 5.0]) for i in range(25)] + [(99, [50.0, -50.0])]
    df = spark.createDataFrame(two, "row_id long, embedding array<double>")
    got = {r.row_id: r.cluster for r in D.density_clusters(df, min_cluster_size=10, min_samples=4).collect()}
    assert {got[i] for i in range(20)} == {1} and {got[20 + i] for i in range(25)} == {0} and got[99] == -1
    few = D.density_clusters(df.limit(5), min_cluster_size=10).collect()
    assert len(few) == 5 and {r.cluster for r in few} == {-1}
    assert D.density_clusters(df.limit(0), min_cluster_size=10).count() == 0
    assert math.isclose(1 / D.LEAST, 1e9)


def test_the_largest_component_does_not_visit(spark, monkeypatch):
    x = np.round(blobs(3), 6)
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "row_id long, embedding array<double>").repartition(2)
    seen = []
    foreign = D._foreign
    monkeypatch.setattr(D, "_foreign", lambda points, active, *a: seen.append((active.select("comp").distinct().count(), active.count(), points.select("comp").distinct().count(),
                                                                                points.groupBy("comp").count().agg(F.max("count")).first()[0])) or foreign(points, active, *a))
    tree = D.spanning_tree(df, "row_id", "embedding", 5)
    assert tree.count() == len(x) - 1 and tree.select("a", "b").distinct().count() == len(x) - 1
    assert all(rows <= len(x) - largest and comps < every for comps, rows, every, largest in seen) and len(seen) > 1


def test_pointers_are_followed_on_the_driver_as_in_tables(spark, monkeypatch):
    rng = np.random.default_rng(2)
    to = {i: int(rng.integers(i + 1, 200)) for i in range(150)}  # chains that end in names without a pointer
    to |= {300: 301, 301: 300, 302: 300, 303: 302}
    picks = spark.createDataFrame(list(to.items()), "comp long, to long")
    made = []
    keep = D.checkpoint_table
    monkeypatch.setattr(D, "checkpoint_table", lambda s, df, name: made.append(name) or keep(s, df, name))
    near = {r.comp: r.root for r in D._follow(picks, "roots").collect()}
    assert made == [] and near[303] == near[300] == near[301] == 300
    monkeypatch.setattr(D, "FOLLOWED_ROWS", 0)
    assert {r.comp: r.root for r in D._follow(picks, "roots").collect()} == near and len(made) > 1


def test_few_distances_are_made_exactly(monkeypatch):
    """The kernel finds each component's shortest edge, but makes only the distances that can be it component by component."""
    import pyarrow as pa

    from civictext.operators import vector_join as V
    rng = np.random.default_rng(7)
    x, q = (rng.normal(size=(n, 3)) + 1_000 for n in (900, 700))  # far from zero: squared distances lose digits
    q[:5] = x[:5]
    core, qcore = rng.uniform(0, 0.1, 900), rng.uniform(0, 0.1, 700)
    comp, qcomp = rng.integers(0, 9, 900), rng.integers(0, 9, 700)
    least = np.where(qcomp < 4, -0.2, -np.inf)
    rows = pa.table({"id": np.arange(900), "v": pa.array(V.pack(x), pa.binary()), "core": core, "comp": comp})
    probes = pa.table({"q": np.arange(1_000, 1_700), "qv": pa.array(V.pack(q), pa.binary()), "qcore": qcore, "qcomp": qcomp, "least": least})
    made = []
    exact = V.pair_distances
    monkeypatch.setattr(V, "pair_distances", lambda q, x, i, j: made.append(len(i)) or exact(q, x, i, j))
    got = {r["comp"]: (r["w"], r["a"], r["b"], r["to"]) for r in D._foreign_block(3)(rows, probes).to_pylist()}
    w = np.maximum(np.maximum(np.round(V.distances(q, x), V.SCORE_DECIMALS), qcore[:, None]), core[None])
    w[(qcomp[:, None] == comp[None]) | (w > -least[:, None])] = np.inf
    want = {}
    for c in range(9):
        best = sorted((w[i, j], int(j), 1_000 + int(i), int(comp[j])) for i in np.flatnonzero(qcomp == c) for j in np.flatnonzero(w[i] == w[qcomp == c].min()) if np.isfinite(w[i, j]))
        if best:
            want[c] = best[0]
    assert got == want and len(want) > 4 and sum(made) < w.size / 20, (sum(made), w.size)
