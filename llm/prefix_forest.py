"""Nearest neighbours by a hash-prefix forest (operator 11).

``search`` returns for each query vector its ``k`` nearest rows by inner product, found approximately.

Method. A tree gives every vector a string of ``BITS`` hash bits (the sides of random planes; vectors get one more
component that brings all to one length, so that the order by angle is the order by inner product) and is the array of its
strings in sorted order. Rows that share a prefix with a query lie next to each other there. A query descends in each tree to
its longest matching prefix, then all trees ascend together, a bit at a time, until the stretches of the query's prefix
hold enough rows over all trees (``wanted``); everything in those stretches is scored exactly.

How far to ascend is read from sorted strings of a bounded sample (about ``SAMPLE`` rows, broadcast), scaled to the table; it
only decides how many rows a query looks at. Every row is indexed: rows go to ``(tree, first bits)`` buckets, a bucket of
more than ``block`` rows is split into salted blocks, and a query goes to all blocks of the buckets that its prefix
covers. A block sorts its strings, finds each query's stretch by two binary searches and returns the ``k`` best of it;
a window with a limit before the shuffle merges them. So a hot bucket is many bounded groups and no pairs are shuffled.

Of equal vectors only the ``k + 1`` with the smallest ids can be among anyone's ``k`` nearest (one may be the query
itself), so the others are left out of the index before it is built, which changes no result.

Defined results: vectors that are null, zero or empty, or hold null or non-finite components, take no part, neither do those of
another width than the most frequent one (ties: the wider) and rows with a null id. Rows of equal id and vector count once; one id
with two vectors is found by the better one. Scores are double-precision inner products of the vectors as they are; ties go to
the smaller id. With fewer than ``k`` candidates all of those found come out. An empty table gives an empty table.
Extra columns are ignored, whatever their names. Very long texts do not occur here.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import empty_like, saved

TREES = 64
BITS = 32
SAMPLE = 16_384  # rows whose strings tell how far to ascend
BLOCK = 4_096  # index rows of one block
QUERIES = 4_096  # queries of one block
SEED = 20_240_611


def wanted(n: int, k: int) -> int:
    """Rows that a query's prefixes shall hold, counted over all trees.

    Set by measurement on isotropic vectors of 64 dimensions, the worst case: 500 to 50,000 rows, recall of 20 nearest above
    0.93. A row counts once a tree, so ``2 * TREES * (k + 1)`` make sure of ``2 * (k + 1)`` different rows, also where near copies
    meet in every tree; a smaller table is looked at as a whole.
    """
    return max(math.ceil(6 * n ** 0.77), 2 * TREES * (k + 1))


def _planes(width: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(SEED)).normal(size=(width + 1, TREES * BITS))


def strings(x: np.ndarray, planes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """``(rows, TREES)`` hash strings as numbers, first bit highest; ``rest``: the component that fills up the length."""
    side = (x @ planes[:-1] + rest[:, None] * planes[-1]) > 0
    return (side.reshape(len(x), TREES, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), width)


def _valid(df: DataFrame, key: str, vec: str) -> DataFrame:
    """``(id, v)`` of the rows that take part, whatever their width."""
    v = F.col(f"`{vec}`")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kind = "array<double>" if df.schema[vec].dataType.simpleString() == "array<double>" else "array<float>"
    return (df.select(F.col(f"`{key}`").cast("long").alias("id"), v.cast(kind).alias("v"), F.coalesce(fine, F.lit(False)).alias("fine"))
            .where("fine and id is not null").select("id", "v"))


def _hashed(width: int, longest: float, planes):
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                x = _matrix(part.column("v"), width) / longest
                own = strings(x, planes.value, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1))))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("v"), pa.ListArray.from_arrays(
                    pa.array(np.arange(0, own.size + 1, TREES), pa.int32()), pa.array(own.reshape(-1)))], ["id", "v", "s"])
    return run


def levels(own: np.ndarray, sample: np.ndarray, each: float, enough: int) -> np.ndarray:
    """Prefix length at which each query stops ascending: the longest with ``enough`` rows over all trees.

    ``own``: ``(queries, TREES)`` strings; ``sample``: ``(TREES, rows)`` sorted strings, each standing for ``each`` rows.
    """
    low, high = np.zeros(len(own), np.int64), np.full(len(own), BITS, np.int64)  # the root always has all rows
    while (low < high).any():
        mid = (low + high + 1) // 2
        shift = BITS - mid
        total = np.zeros(len(own))
        for t in range(TREES):
            first = (own[:, t] >> shift) << shift
            total += np.searchsorted(sample[t], first + (1 << shift)) - np.searchsorted(sample[t], first)
        up = total * each >= enough
        low, high = np.where(up, mid, low), np.where(up, high, mid - 1)
    return low


def _visits(width: int, longest: float, planes, sample, each: float, enough: int, bits: int):
    """One row for each query, tree and bucket that its prefix covers, with the prefix's first and last string."""
    def run(batches):
        for b in batches:
            for a in range(0, b.num_rows, 256):
                part = b.slice(a, 256)
                x = _matrix(part.column("v"), width) / longest
                # a query has no filling component: longer or shorter, it looks into the same direction
                own = strings(x / np.linalg.norm(x, axis=1, keepdims=True), planes.value, np.zeros(len(x)))
                level = levels(own, sample.value, each, enough)
                shift = (BITS - level)[:, None]
                first = (own >> shift) << shift
                last = first + (1 << shift) - 1
                from_, to = first >> (BITS - bits), last >> (BITS - bits)
                many = (to - from_ + 1).reshape(-1)
                at = np.repeat(np.arange(many.size), many)
                bucket = from_.reshape(-1)[at] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
                row, tree = at // TREES, at % TREES
                take = pa.array(row)
                for c in range(0, len(at), 8192):
                    s = slice(c, c + 8192)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("id").take(take[s]), part.column("v").take(take[s]), pa.array(tree[s], pa.int32()), pa.array(bucket[s], pa.int64()),
                         pa.array(first.reshape(-1)[at[s]]), pa.array(last.reshape(-1)[at[s]])], ["query_id", "qv", "tree", "bucket", "first", "last"])
    return run


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows with rows, each summed in the same order, so that equal vectors score equally."""
    return (q * x).sum(axis=1)


def _best(k: int, width: int):
    """The ``k`` best rows of each query in one block."""
    def run(rows: pa.Table, visits: pa.Table) -> pa.Table:
        out_q, out_i, out_s = [], [], []
        if rows.num_rows and visits.num_rows:
            order = np.argsort(rows.column("s").to_numpy(), kind="stable")
            s, ids = rows.column("s").to_numpy()[order], rows.column("id").to_numpy()[order]
            x = _matrix(rows.column("v"), width)[order]
            q = _matrix(visits.column("qv"), width)
            who = visits.column("query_id").to_numpy()
            a = np.searchsorted(s, visits.column("first").to_numpy())
            z = np.searchsorted(s, visits.column("last").to_numpy(), "right")
            for r in np.flatnonzero(z > a).tolist():
                at = np.arange(a[r], z[r])
                at = at[ids[at] != who[r]]
                if len(at) > k:
                    rough = x[a[r]:z[r]] @ q[r]
                    rough = rough[at - a[r]]
                    cut = np.partition(rough, len(at) - k)[len(at) - k]
                    at = at[rough >= cut - 1e-9 * (1 + abs(cut))]
                score = exact(q[r][None, :], x[at])
                top = np.lexsort((ids[at], -score))[:k]
                out_q.append(np.full(len(top), who[r])), out_i.append(ids[at][top]), out_s.append(score[top])
        join = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
        return pa.table({"query_id": join(out_q, pa.int64()), "id": join(out_i, pa.int64()), "score": join(out_s, pa.float64())})
    return lambda left, right: run(left, right)


def search(index: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vec: str = "embedding", block: int = BLOCK,
           sample_rows: int = SAMPLE) -> DataFrame:
    """``(query_id, rank, id, score)``: the nearest rows found for each of ``queries``, never the row of the query's own id.

    Both tables have the columns ``key`` and ``vec``.
    """
    spark = index.sparkSession
    nothing = empty_like(spark, "query_id long, rank int, id long, score double")
    rows = _valid(index, key, vec)
    widths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if widths is None:
        return nothing
    width = widths["d"]
    rows = rows.where(F.size("v") == width).distinct()
    # of equal vectors the k + 1 smallest ids; the limit acts before the shuffle, so a hot vector is no hot task
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = rows.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
    rows = saved(rows, "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm).alias("longest")).first()
    n, longest = size["n"], float(size["longest"])
    planes = spark.sparkContext.broadcast(_planes(width))
    vkind = rows.schema["v"].dataType.simpleString()
    hashed = saved(rows.mapInArrow(_hashed(width, longest, planes), f"id long, v {vkind}, s array<long>"), "strings")

    share = min(1.0, sample_rows / n)
    picked = hashed.where(F.pmod(F.xxhash64("id", F.lit(SEED)), F.lit(1 << 32)) < int(share * (1 << 32)) + (share >= 1)).select("s").toArrow()
    sample = np.sort(picked.column("s").combine_chunks().flatten().to_numpy().reshape(-1, TREES).T, axis=1) if picked.num_rows else np.zeros((TREES, 0), np.int64)
    bits = max(0, min(16, math.ceil(math.log2(max(1.0, n / block)))))
    each = n / max(1, sample.shape[1])
    asked = _valid(queries, key, vec).where(F.size("v") == width).distinct().select("id", F.col("v").cast(vkind).alias("v"))
    visits = saved(asked.mapInArrow(_visits(width, longest, planes, spark.sparkContext.broadcast(sample), each, wanted(n, k), bits),
                                    f"query_id long, qv {vkind}, tree int, bucket long, first long, last long"), "visits")
    placed = hashed.select("id", "v", F.posexplode("s").alias("tree", "s")).withColumn("bucket", F.shiftright("s", BITS - bits))

    counts = lambda df, per, name: df.groupBy("tree", "bucket").agg(F.ceil(F.count(F.lit(1)) / per).cast("int").alias(name))
    # at most TREES * 2**16 buckets
    blocks = saved(counts(hashed.select(F.posexplode("s").alias("tree", "s")).withColumn("bucket", F.shiftright("s", BITS - bits)), block, "n_i")
                   .join(counts(visits, QUERIES, "n_q"), ["tree", "bucket"]), "blocks")
    left = (placed.join(blocks, ["tree", "bucket"]).withColumn("i", F.pmod(F.xxhash64("id"), F.col("n_i")).cast("int"))
            .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1))).drop("n_i", "n_q"))
    right = (visits.join(blocks, ["tree", "bucket"]).withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("n_q")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1))).drop("n_i", "n_q"))
    by = ("tree", "bucket", "i", "q")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(k, width), "query_id long, id long, score double")
    # a row is found in several trees with the same score
    found = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
