"""Density clusters with true outliers: mutual reachability, minimum spanning tree, condensed tree.

A row's core distance is that to its ``min_samples``-th nearest other row; two rows are as far apart as the
greatest of their distance and their core distances (mutual reachability). Clusters are the stable branches of
the single-linkage tree of these distances; rows that belong to none are -1. What merges at one distance merges at
once (equal core distances make such ties common), so the result does not depend on the order of equal edges.

* Neighbour lists come from ``vector_join.top_k`` (exact, pruned by cells).
* The minimum spanning tree grows in Boruvka rounds: each component takes its shortest edge to another one. Candidates are the
  neighbour lists first; a row whose list ends before the component's candidate may have a nearer row outside its list, and visits the
  cells that can hold one. The largest component takes none: the others' edges reach it. Edges are ordered by (distance, ids), so rounds never close a circle. There are O(log n) rounds,
  each with written tables.
* Components below ``min_cluster_size`` are contracted along their shortest tree edges, in the order of the lengths. This
  gives each row the leaf (a cluster without smaller ones) that it joins, and the distance at which it does; the tree edges left
  are the merges of clusters that are large enough on both sides.
* Only these merges, fewer than rows / ``min_cluster_size``, are put in order on the driver, under a checked bound (``MAX_LEAVES``). The sums
  over rows that rate the branches are an aggregate.

Defined results: equal rows are at distance 0 (rated as ``LEAST``); fewer rows than ``min_cluster_size``, or no two
branches that are large enough: all rows are -1 (the whole table is no cluster). An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..sources.store import checkpoint_table
from . import vector_join as VJ

MAX_LEAVES = 1_000_000
LEAST = 1e-9  # the least distance that is rated
FOLLOWED_ROWS = 1 << 20  # pointers that the driver follows: 16 MB; more are doubled as tables


def _followed(picks: DataFrame) -> DataFrame:
    """``_follow`` of at most ``FOLLOWED_ROWS`` pointers, on the driver (two numbers a pointer)."""
    table = picks.select("comp", "to").toArrow()
    comp, to = (table.column(c).to_numpy() for c in ("comp", "to"))
    order = np.argsort(comp)
    comp, to = comp[order], to[order]
    names = np.unique(np.concatenate((comp, to)))  # a name without a pointer is a root
    at = np.arange(len(names))
    at[np.searchsorted(names, comp)] = np.searchsorted(names, to)
    pair = (at[at] == np.arange(len(at))) & (np.arange(len(at)) < at)
    at[pair] = np.flatnonzero(pair)
    while (at[at] != at).any():
        at = at[at]
    root = names[at[np.searchsorted(names, comp)]]
    out = picks.sparkSession.createDataFrame(pa.table({"comp": pa.array(comp, pa.int64()), "root": pa.array(root, pa.int64())}))
    return F.broadcast(out) if len(comp) <= VJ.MAX_BROADCAST_ROWS else out


def _follow(picks: DataFrame, name: str) -> DataFrame:
    """``(comp, root)`` of pointers ``(comp, to)`` whose only circles are pairs; a pair's root is its smaller one.

    Pointers are doubled until none moves; a ``to`` that has no pointer itself is a root.
    """
    spark = picks.sparkSession
    if picks.count() <= FOLLOWED_ROWS:
        return _followed(picks)
    back = picks.select(F.col("comp").alias("to"), F.col("to").alias("back"))
    root = picks.join(back, "to", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")), F.col("comp")).otherwise(F.col("to")).alias("root"))
    root = checkpoint_table(spark, root, name)
    while True:
        up = root.select(F.col("comp").alias("root"), F.col("root").alias("next"))
        moved = root.join(up, "root", "left").select("comp", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved"))
        moved = checkpoint_table(spark, moved, name)
        root = moved.select("comp", "root")
        if moved.where("moved").isEmpty():
            return root


def _foreign_block(width: int):
    """For each component of the visitors its shortest edge to a row of another component in this group."""
    def run(rows: pa.Table, probes: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if rows.num_rows and probes.num_rows:
            x, q = VJ.unpack(rows.column("v"), width), VJ.unpack(probes.column("qv"), width)
            ids, core, comp = (rows.column(c).to_numpy() for c in ("id", "core", "comp"))
            who, qcore, qcomp, least = (probes.column(c).to_numpy() for c in ("q", "qcore", "qcomp", "least"))
            names, place = np.unique(qcomp, return_inverse=True)
            shortest = np.full(len(names), np.inf)  # so far, of each visiting component
            off = VJ.squares_off(q, x)
            for a, b, s in VJ._tiles(q, x, True):
                h, w = s.shape
                other = qcomp[a:a + h, None] != comp[None, b:b + w]
                most = np.minimum(-least[a:a + h], shortest[place[a:a + h]])
                free = np.flatnonzero(np.isinf(most))  # no edge is known yet: not longer than the shortest of this tile
                if len(free):
                    d = np.maximum(np.maximum(np.sqrt(np.maximum(s[free], 0.0) + off), qcore[a + free, None]), core[None, b:b + w])
                    most[free] = np.where(other[free], d, np.inf).min(axis=1)
                other &= s <= ((most + VJ.EPS) ** 2 + off)[:, None]
                i, j = np.nonzero(other)  # few pairs are left whose distance is wanted exactly
                i, j = i + a, j + b
                d = np.maximum(np.maximum(np.round(VJ.pair_distances(q, x, i, j), VJ.SCORE_DECIMALS), qcore[i]), core[j])
                keep = d <= np.minimum(-least[i], shortest[place[i]])
                i, j, d = i[keep], j[keep], d[keep]
                np.minimum.at(shortest, place[i], d)
                keep = d == shortest[place[i]]
                i, j, d = i[keep], j[keep], d[keep]
                found.append((qcomp[i], d, np.minimum(who[i], ids[j]), np.maximum(who[i], ids[j]), comp[j]))
        cols = [np.concatenate(v) for v in zip(*found)] if found else [np.zeros(0)] * 5
        order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))  # ties: the edge of the smaller ids
        order = order[np.diff(cols[0][order], prepend=np.nan) != 0]
        cols = [v[order] for v in cols]
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("comp", "w", "a", "b", "to"), cols, (pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()))})
    return lambda left, right: run(left, right)


def _foreign(points: DataFrame, active: DataFrame, cells: VJ.Cells, width: int, block_rows: int) -> DataFrame:
    """Edges ``(comp, w, a, b, to)``: the shortest of each visiting component found in each group of blocks."""
    spark = points.sparkSession
    only = np.full(len(cells.rows), -1, np.int64)  # the component of all rows of a cell: its own rows need not visit it
    mixed = np.ones(len(cells.rows), dtype=bool)
    for r in points.groupBy("cell").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).collect():
        only[r["cell"]], mixed[r["cell"]] = r["a"], r["a"] != r["b"]
    shared = spark.sparkContext.broadcast((cells.plain(), only, mixed))

    def visit(batches):
        plain, only, mixed = shared.value
        cells = VJ.Cells(*plain)
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                row, cell = VJ.reachable(VJ.unpack(part.column("v"), width), part.column("least").to_numpy(), cells)
                keep = mixed[cell] | (only[cell] != part.column("comp").to_numpy()[row])
                row, cell = row[keep], cell[keep]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(take) for c in ("id", "v", "core", "comp", "least")], pa.array(cell.astype(np.int32))],
                                                 ["q", "qv", "qcore", "qcomp", "least", "cell"])

    probes = checkpoint_table(spark, active.select("id", "v", "core", "comp", "least").mapInArrow(visit, "q long, qv binary, qcore double, qcomp long, least double, cell int"), "foreign-visits")
    seen = VJ.counted_visits(probes, len(cells.rows))
    blocks = [(c, math.ceil(n / block_rows), max(1, math.ceil(v / block_rows))) for c, (n, v) in enumerate(zip(cells.rows.tolist(), seen.tolist()))]
    sizes = F.broadcast(spark.createDataFrame(blocks, "cell int, n_i int, n_q int"))  # one row a cell
    left = (points.select("id", "v", "core", "comp", "cell").join(sizes, "cell").withColumn("i", F.pmod(F.xxhash64("id"), F.col("n_i")).cast("int"))
            .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1))).drop("n_i", "n_q"))
    right = (probes.join(sizes, "cell").withColumn("s", F.pmod(F.xxhash64("q"), F.col("n_q")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1))).drop("n_i", "n_q"))
    return (left.groupBy("cell", "i", "s").cogroup(right.groupBy("cell", "i", "s"))
            .applyInArrow(_foreign_block(width), "comp long, w double, a long, b long, to long"))


def spanning_tree(df: DataFrame, key: str, vec: str, min_samples: int, block_rows: int = VJ.BLOCK_ROWS, pivot_rows: int = VJ.PIVOT_ROWS, seed: int = L.SEED) -> DataFrame:
    """Edges ``(a, b, w)``, ``a < b``, of the minimum spanning tree of mutual reachability distances."""
    spark = df.sparkSession
    width = VJ.vector_width(df, vec)
    rows = checkpoint_table(spark, VJ.packed(df, key, vec, width).select(F.col("id").cast("long").alias("id"), "v", "norm"), "density-rows")
    both = df.select(F.col(key).cast("long").alias("id"), F.col(vec).alias("v"))
    near = VJ.top_k(both, both.withColumnRenamed("id", "q"), min_samples + 1, None, "id", "q", "v", None, block_rows, pivot_rows, seed, l2=True)
    near = checkpoint_table(spark, near.where("q <> id").select("q", "id", (-F.col("score")).alias("d")), "density-neighbours")
    # with more than min_samples equal rows a row may miss in its own list: the farthest of the list is the core distance all the same
    core = checkpoint_table(spark, near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("r") <= min_samples)
                            .groupBy("q").agg(F.max("d").alias("core")), "core-distances")
    placed, cells, _ = VJ.build_cells(rows, rows.count(), width, seed, pivot_rows, l2=True)
    points = checkpoint_table(spark, placed.join(core.withColumnRenamed("q", "id"), "id").select("id", "v", "cell", "core", F.col("id").alias("comp")), "density-points")
    lists = (near.join(core, "q").join(core.select(F.col("q").alias("id"), F.col("core").alias("other")), "id")
             .select(F.least("q", "id").alias("a"), F.greatest("q", "id").alias("b"), F.greatest("d", "core", "other").alias("w")).distinct())
    lists = checkpoint_table(spark, lists, "density-lists")
    tree: list[DataFrame] = []
    lists = lists.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))  # at first a row is a component
    while True:
        sides = lists.select(F.col("ca").alias("comp"), "w", "a", "b", F.col("cb").alias("to")).unionByName(lists.select(F.col("cb").alias("comp"), "w", "a", "b", F.col("ca").alias("to")))
        least = lambda edges: edges.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("comp", "e.*")
        known = checkpoint_table(spark, least(sides), "density-candidates")
        # the largest component waits for the others' edges to it: in late rounds it holds nearly all rows, and all of them would visit
        largest = points.groupBy("comp").count().orderBy(F.desc("count"), "comp").limit(1).first()["comp"]
        known = known.where(F.col("comp") != largest)
        # only a row whose list ends at or before the candidate can have a nearer row beyond the list
        active = (points.where(F.col("comp") != largest).join(known.select("comp", "w"), "comp", "left").where(F.col("w").isNull() | (F.col("core") <= F.col("w")))
                  .withColumn("least", F.coalesce(-F.col("w"), F.lit(-math.inf))))
        picks = checkpoint_table(spark, least(known.unionByName(_foreign(points, active, cells, width, block_rows))), "density-picks")
        if picks.isEmpty():
            break
        tree.append(picks.select("a", "b", "w").distinct())
        root = _follow(picks.select("comp", "to"), "density-roots")
        points = checkpoint_table(spark, points.join(root, "comp", "left").select("id", "v", "cell", "core", F.coalesce("root", "comp").alias("comp")), "density-points")
        moved = lambda edges, c: edges.join(root.toDF(c, "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        # edges inside a component are done with
        lists = checkpoint_table(spark, moved(moved(lists, "ca"), "cb").where("ca <> cb").select("a", "b", "w", "ca", "cb"), "density-lists")
    out = spark.createDataFrame([], "a long, b long, w double")
    for part in tree:
        out = out.unionByName(part)
    return checkpoint_table(spark, out, "spanning-tree")


def join_leaves(ids: DataFrame, tree: DataFrame, min_cluster_size: int) -> tuple[DataFrame, DataFrame]:
    """``(id, leaf, at)`` of rows: the leaf each joins and the distance at which it does; and the merges ``(x, y, w)`` of leaves.

    Each component below ``min_cluster_size`` points along its shortest tree edge; along such pointers the lengths fall. A chain of them
    that ends in a large component joins it, each at the length of its own edge. The others end in two small
    components that point at each other: the members of such a group are put together by the length of their edges, as far as no edge that
    leaves the group is shorter, so that every component is one of the single-linkage tree. When they reach the least size
    a leaf is born, and the group's longer members join it; else they are a component of the next round.
    """
    spark = ids.sparkSession
    where = checkpoint_table(spark, ids.select("id", F.col("id").alias("comp"), F.lit(None).cast("double").alias("at")), "leaf-rows")
    size = checkpoint_table(spark, ids.select(F.col("id").alias("comp"), F.lit(1).cast("long").alias("n")), "leaf-sizes")
    edges = tree.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    while True:
        small = size.where(F.col("n") < min_cluster_size)
        sides = edges.select(F.col("ca").alias("comp"), "w", "a", "b", F.col("cb").alias("to")).unionByName(edges.select(F.col("cb").alias("comp"), "w", "a", "b", F.col("ca").alias("to")))
        sides = sides.join(small.select("comp"), "comp")
        picks = checkpoint_table(spark, sides.groupBy("comp").agg(F.min(F.struct("w", "a", "b", "to")).alias("e")).select("comp", "e.w", "e.to"), "leaf-picks")
        if picks.isEmpty():
            break
        root = _follow(picks.select("comp", "to"), "leaf-roots")
        grouped = root.unionByName(size.where(F.col("n") >= min_cluster_size).select("comp", F.col("comp").alias("root")))
        leaving = (sides.join(root, "comp").join(grouped.toDF("to", "other"), "to", "left").where("root <> coalesce(other, -root - 1)")
                   .groupBy("comp").agg(F.min("w").alias("out")))
        own = size.select(F.col("comp").alias("root"), F.col("n").alias("own"))
        member = root.join(picks.select("comp", "w"), "comp").join(size, "comp").join(own, "root").join(leaving, "comp", "left")
        member = checkpoint_table(spark, member.withColumn("new", F.col("own") < min_cluster_size), "leaf-members")
        # of a group of small components the first few by length decide: so many reach the least size
        order = Window.partitionBy("root").orderBy("w", "comp")
        first = member.where("new").withColumn("r", F.row_number().over(order)).where(F.col("r") <= min_cluster_size)
        first = (first.withColumn("total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)))
                 .withColumn("shut", F.min("out").over(order.rowsBetween(Window.unboundedPreceding, -1)))
                 .where(F.col("shut").isNull() | (F.col("w") <= F.col("shut"))))
        first = checkpoint_table(spark, first.select("comp", "root", "n", F.when(F.col("total") >= min_cluster_size, F.col("w")).alias("full")), "leaf-first")
        born = first.groupBy("root").agg(F.min("full").alias("born"))
        joins = (member.join(born, "root", "left").join(first.select("comp", F.lit(True).alias("early")), "comp", "left")
                 .withColumn("at", F.when(~F.col("new"), F.col("w")).when(F.col("born").isNotNull(), F.greatest("w", "born")))
                 .where(F.col("at").isNotNull() | F.col("early")).select("comp", "root", "n", F.col("at").alias("joins"), "new", "own"))
        joins = checkpoint_table(spark, joins, "leaf-joins")
        where = checkpoint_table(spark, where.join(joins.select("comp", "root", "joins"), "comp", "left")
                                 .select("id", F.coalesce("root", "comp").alias("comp"), F.coalesce("at", "joins").alias("at")), "leaf-rows")
        grown = joins.groupBy("root").agg((F.sum("n") + F.max(F.when(F.col("new"), 0).otherwise(F.col("own")))).alias("n")).withColumnRenamed("root", "comp")
        kept = size.join(joins.select("comp"), "comp", "left_anti").join(grown.select("comp"), "comp", "left_anti")
        size = checkpoint_table(spark, kept.unionByName(grown), "leaf-sizes")
        comp_of = where.select("id", "comp")
        edges = checkpoint_table(spark, tree.join(comp_of.toDF("a", "ca"), "a").join(comp_of.toDF("b", "cb"), "b").where("ca <> cb").select("a", "b", "w", "ca", "cb"), "leaf-edges")
    return where.select("id", F.col("comp").alias("leaf"), "at"), edges.select(F.col("ca").alias("x"), F.col("cb").alias("y"), "w")


def branch_at(parent: np.ndarray, ends: np.ndarray, leaf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The branch that holds a leaf at a distance."""
    out = leaf.copy()
    while True:
        up = ends[out] <= at
        if not up.any():
            return out
        out = np.where(up, parent[out], out)


class MergeTree:
    """Branches of the leaves' merges: parent, the distance at which a branch ends in its parent, and where it splits.

    Merges of one distance happen at once. A leaf that is born at the distance at which it merges never stands alone: its
    rows belong to the branch that it meets.
    """

    def __init__(self, born: dict[int, float], merges: list[tuple[float, int, int]]):
        names = sorted(born)
        place = {x: i for i, x in enumerate(names)}
        self.parent, self.ends, self.splits = list(range(len(names))), [math.inf] * len(names), [0.0] * len(names)
        self.kids: list[tuple[int, ...]] = [()] * len(names)
        start = [born[x] for x in names]
        top, found = list(range(len(names))), list(range(len(names)))
        same = list(range(len(names)))  # the branch that a leaf's rows start in

        def find(v: int) -> int:
            while found[v] != v:
                found[v] = found[found[v]]
                v = found[v]
            return v

        merges = sorted(merges)
        i = 0
        while i < len(merges):
            j = i
            while j < len(merges) and merges[j][0] == merges[i][0]:
                j += 1
            w, groups = merges[i][0], {}
            for _, x, y in merges[i:j]:
                for side in (find(place[x]), find(place[y])):
                    groups.setdefault(side, {side})
            for _, x, y in merges[i:j]:
                a, b = find(place[x]), find(place[y])
                if a != b:
                    found[a] = b
                    groups[b] |= groups.pop(a)
            for root, members in groups.items():
                branches = sorted(top[m] for m in members)
                older = [b for b in branches if start[b] < w]
                if len(older) > 1:
                    node = len(self.parent)
                    self.parent.append(node), self.ends.append(math.inf), self.splits.append(w), self.kids.append(tuple(older))
                    start.append(w)
                    for b in older:
                        self.parent[b], self.ends[b] = node, w
                else:
                    node = (older or branches)[0]
                for b in branches:
                    if b not in older and b != node:
                        same[b] = node
                top[root] = node
            i = j
        self.place = {x: same[k] for x, k in place.items()}
        self.gone = {b for b, to in enumerate(same) if to != b}

    def chosen(self, rows: dict[int, tuple[int, float]]) -> dict[int, int]:
        """``branch -> chosen cluster`` for all branches inside one; ``rows``: number and sum of 1 / distance of the rows that join each."""
        n = len(self.parent)
        count, rating, best = [0] * n, [0.0] * n, [0.0] * n
        taken = [False] * n
        for i in range(n):  # children come before their parents
            own, inverse = rows.get(i, (0, 0.0))
            below = sum(count[k] for k in self.kids[i])
            count[i] = own + below
            start = 1 / max(self.ends[i], LEAST) if self.ends[i] < math.inf else 0.0
            rating[i] = inverse - own * start + (below * (1 / max(self.splits[i], LEAST) - start) if self.kids[i] else 0.0)
            inside = sum(best[k] for k in self.kids[i])
            if i not in self.gone and self.parent[i] != i and (not self.kids[i] or rating[i] >= inside):
                taken[i], best[i] = True, rating[i]
            else:
                best[i] = inside
        out: dict[int, int] = {}
        for i in range(n - 1, -1, -1):
            up = out.get(self.parent[i]) if self.parent[i] != i else None
            if up is not None:
                out[i] = up
            elif taken[i]:
                out[i] = i
        return out


def density_clusters(df: DataFrame, key: str = "row_id", vec: str = "embedding", min_cluster_size: int = 15, min_samples: int | None = None,
                     block_rows: int = VJ.BLOCK_ROWS, pivot_rows: int = VJ.PIVOT_ROWS, seed: int = L.SEED) -> DataFrame:
    """``(key, cluster, joins_at)`` for every row: clusters by size, the largest is 0 (ties: the smallest id), outliers -1.

    ``joins_at``: the distance at which the row joins a group of ``min_cluster_size`` (null: never).
    """
    spark = df.sparkSession
    samples = min_samples or min_cluster_size
    kind = df.schema[key].dataType.simpleString()
    if df.limit(min_cluster_size).count() < min_cluster_size:
        return df.select(key, F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("joins_at"))
    ids = df.select(F.col(key).cast("long").alias("id"))
    tree = spanning_tree(df, key, vec, samples, block_rows, pivot_rows, seed)
    where, merges = join_leaves(ids, tree, min_cluster_size)
    leaves = checkpoint_table(spark, where.where("at is not null").groupBy("leaf").agg(F.min("at").alias("born")), "density-leaves")
    if leaves.count() > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} smallest clusters: choose a larger min_cluster_size")
    order = MergeTree({r["leaf"]: r["born"] for r in leaves.collect()}, [(r["w"], r["x"], r["y"]) for r in merges.collect()])
    if not order.place:  # not one group is large enough
        return df.select(key, F.lit(-1).alias("cluster"), F.lit(None).cast("double").alias("joins_at"))
    names = sorted(order.place)
    shared = spark.sparkContext.broadcast((np.array(names, np.int64), np.array([order.place[x] for x in names]), np.array(order.parent), np.array(order.ends)))

    def branches(batches):
        names, place, parent, ends = shared.value
        for b in batches:
            leaf = place[np.searchsorted(names, b.column("leaf").to_numpy())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), pa.array(branch_at(parent, ends, leaf, b.column("at").to_numpy(zero_copy_only=False)))],
                                             ["id", "at", "branch"])

    placed = checkpoint_table(spark, where.mapInArrow(branches, "id long, at double, branch long"), "density-branches")
    rated = placed.groupBy("branch").agg(F.count(F.lit(1)).alias("n"), F.sum(1 / F.greatest("at", F.lit(LEAST))).alias("s")).collect()  # at most 2 * MAX_LEAVES rows
    chosen = order.chosen({r["branch"]: (r["n"], r["s"]) for r in rated})
    names = spark.createDataFrame(list(chosen.items()), "branch long, chosen long")
    names = F.broadcast(names) if len(chosen) <= VJ.MAX_BROADCAST_ROWS else names
    found = checkpoint_table(spark, placed.join(names, "branch", "left").select("id", "at", "chosen"), "density-chosen")
    sizes = found.where("chosen is not null").groupBy("chosen").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    number = sizes.select("chosen", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "least")) - 1).alias("cluster"))  # one row a cluster
    return found.join(number, "chosen", "left").select(F.col("id").cast(kind).alias(key), F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster"), F.col("at").alias("joins_at"))
