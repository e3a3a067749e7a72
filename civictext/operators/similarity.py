"""Vector similarity: exact top-k search, near-duplicate pairs, verdicts, IVF.

Exact top-k is computed by block kernels, never by a join that emits all
pairs:

* **Broadcast path** -- when the query side fits one chunk under a byte bound
  (checked by a count before anything is collected), it is broadcast and every
  index partition computes ``Q @ B.T`` per Arrow batch with NumPy, emitting
  only its per-batch top-k.
* **Pruned path** -- otherwise (for example when the query side is the table
  itself) ``vector_join.top_k``: cells with bounds, two rounds, salted blocks.
  Near duplicates take ``vector_join.links``.

Scores are made in tiles of at most ``TILE_BYTES`` with a running top-k per query,
so a kernel's memory follows neither the query side nor the Arrow batch.

A ``row_number() <= k`` window per query (planned as a partial group limit
before the shuffle) merges the partial lists. Score ties are made exact at 12
decimal places and broken by the smaller id.

IVF with a fixed ``nprobe`` restricts a search to each query's nearest KMeans cells: the
broadcast path carries an inverted list cell -> probing queries, the block
path salts each cell separately, so a hot cell becomes many bounded blocks. Without
``nprobe`` each query visits as many cells as a measured recall asks for.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from . import vector_join as VJ

DEFAULT_CHUNK_BYTES = 64 << 20  # broadcast bound for the query side
DEFAULT_BLOCK_ROWS = 8_000  # rows per side of one block group
TILE_BYTES = 32 << 20  # one tile of scores or of centroid distances
TILE_WIDTH = 2_048  # index rows of one tile
MAX_BROADCAST_ROWS = 100_000  # rows of a small side (hits, block counts) allowed in a broadcast
SCORE_DECIMALS = 12  # scores are compared at this precision; ties then go to the smaller id
IVF_RECALL = 0.97  # share of the calibration queries' true neighbours that an adaptive search must reach
IVF_CELL_ROWS = 256  # rows a cell stands for
IVF_MAX_CELLS = 1_024
LOCAL_STATISTICS = 1_000_000  # cells squared times width from which the library's KMeans collects the distances of all pairs of centroids


def _dtype_of(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _fits_broadcast(queries: DataFrame, qvec: str, max_bytes: int) -> tuple[int, int, bool]:
    """(rows, width, fits): the query side's size, measured before any collect."""
    stats = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(qvec)).alias("d")).first()
    n, d = int(stats["n"]), int(stats["d"] or 0)
    return n, d, n * (d * 8 + 64) <= max_bytes


def _collect_queries(queries: DataFrame, qkey: str, qvec: str, d: int):
    """Keys and the (n, d) matrix of a query side whose size ``_fits_broadcast`` checked.

    Collected as one Arrow table (flat value buffers), not as Python rows.
    """
    t = queries.select(qkey, F.col(qvec).cast("array<double>").alias(qvec)).toArrow()
    keys = t.column(0).to_numpy(zero_copy_only=False)
    vecs = t.column(1).combine_chunks()
    sizes = vecs.value_lengths().to_numpy(zero_copy_only=False) if len(vecs) else np.zeros(0, dtype=np.int64)
    if len(sizes) and (sizes != d).any():
        raise ValueError(f"query vectors must all have {d} values")
    mat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(keys), d)
    return keys, mat


def _topk_cells(S: np.ndarray, ids: np.ndarray, k: int, threshold: float | None):
    """(row, col) positions of each row's top ``k`` scores (>= threshold); ties at the
    cut keep the smallest ids, so no more than ``k`` per row are emitted."""
    nb = S.shape[1]
    if k >= nb:  # nothing is cut
        return np.nonzero(S >= (-np.inf if threshold is None else threshold))
    kk = k
    kth = np.partition(S, nb - kk, axis=1)[:, nb - kk]
    mask = S >= kth[:, None]
    if threshold is not None:
        mask &= S >= threshold
    counts = mask.sum(axis=1)
    for r in np.nonzero(counts > kk)[0]:
        idx = np.nonzero(mask[r])[0]
        keep = idx[np.lexsort((ids[idx], -S[r, idx]))[:kk]]
        mask[r] = False
        mask[r, keep] = True
    return np.nonzero(mask)


def _scores(Q: np.ndarray, B: np.ndarray) -> np.ndarray:
    # BLAS may give equal vectors scores that differ in the last bit; rounding to
    # 12 places makes such ties exact, so they are broken by id as specified
    return np.round(Q @ B.T, SCORE_DECIMALS)


def _cut(best: tuple[np.ndarray, ...], ids: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The top ``k`` of each query among (query row, index row, score) candidates."""
    qi, bi, sc = best
    order = np.lexsort((ids[bi], -sc, qi))
    qi = qi[order]
    first = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1]))) if len(qi) else np.zeros(0, np.int64)
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
    keep = order[rank < k]
    return best[0][keep], bi[keep], sc[keep]


def _tiled_topk(Q: np.ndarray, B: np.ndarray, ids: np.ndarray, k: int, threshold: float | None):
    """(query rows, index rows, scores) of one tile of queries at a time."""
    width = max(1, min(len(B), TILE_WIDTH))
    height = max(1, TILE_BYTES // (8 * width))
    for a in range(0, len(Q), height):
        best = None
        for b in range(0, len(B), width):
            S = _scores(Q[a:a + height], B[b:b + width])
            qi, bi = _topk_cells(S, ids[b:b + width], k, threshold)
            new = (qi + a, bi + b, S[qi, bi])
            best = new if best is None else tuple(np.concatenate(x) for x in zip(best, new))
            if b and k < len(B):
                best = _cut(best, ids, k)
        if best is not None and len(best[0]):
            yield best


def _matrix(col) -> np.ndarray:
    """One matrix of a column of equally long vectors, through one flat buffer."""
    flat = np.concatenate(col) if len(col) else np.zeros(0)
    return flat.astype(np.float64, copy=False).reshape(len(col), -1)


def _merge_topk(cand: DataFrame, query_key: str, index_key: str, k: int, round_to: int | None) -> DataFrame:
    """Global top-k per query from partial lists (partial group limit before the shuffle)."""
    w = Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc(index_key))
    top = cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    if round_to is not None:
        top = top.withColumn("score", F.round("score", round_to))
    return top.select(query_key, index_key, "score", "rank")


def _block_topk(index: DataFrame, queries: DataFrame, index_key: str, query_key: str, vec: str, qvec: str,
                k: int, threshold: float | None, block_rows: int) -> DataFrame:
    """Candidate top-k rows from salted blocks; both sides carry an int ``cell``.

    Index rows of cell c are spread over ``ceil(|I_c| / block_rows)`` index salts
    and replicated to each query salt of c; query rows probing c are spread over
    ``ceil(|Q_c| / block_rows)`` query salts and replicated to each index salt.
    Every (cell, index salt, query salt) group therefore holds about
    ``block_rows`` rows per side and emits at most ``k`` rows per query.
    """
    itype, qtype = _dtype_of(index, index_key), _dtype_of(queries, query_key)
    from ..sources.store import checkpoint_table

    def blocks(side, out):
        return side.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(out))

    # one row per cell; the sides are joined to it, so there is no literal map however many cells
    sizes = checkpoint_table(index.sparkSession, blocks(index, "n_i").join(blocks(queries, "n_q"), "cell"), "cell-blocks")
    sizes = F.broadcast(sizes) if sizes.count() <= MAX_BROADCAST_ROWS else sizes
    left = (index.select(index_key, vec, "cell").join(sizes, "cell")
            .withColumn("isalt", F.pmod(F.xxhash64(F.col(index_key)), F.col("n_i")).cast("int"))
            .withColumn("qsalt", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1))).drop("n_i", "n_q"))
    right = (queries.select(query_key, F.col(qvec).alias("_qv"), "cell").join(sizes, "cell")
             .withColumn("qsalt", F.pmod(F.xxhash64(F.col(query_key)), F.col("n_q")).cast("int"))
             .withColumn("isalt", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1))).drop("n_i", "n_q"))

    def block(ipdf: pd.DataFrame, qpdf: pd.DataFrame) -> pd.DataFrame:
        if len(ipdf) == 0 or len(qpdf) == 0:
            return pd.DataFrame({query_key: [], index_key: [], "score": []})
        ids, keys = ipdf[index_key].to_numpy(), qpdf[query_key].to_numpy()
        out = [pd.DataFrame({query_key: keys[qi], index_key: ids[bi], "score": sc})
               for qi, bi, sc in _tiled_topk(_matrix(qpdf["_qv"].to_numpy()), _matrix(ipdf[vec].to_numpy()), ids, k, threshold)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({query_key: [], index_key: [], "score": []})

    return (left.groupBy("cell", "isalt", "qsalt")
            .cogroup(right.groupBy("cell", "isalt", "qsalt"))
            .applyInPandas(block, f"{query_key} {qtype}, {index_key} {itype}, score double"))


def search(index: DataFrame, queries: DataFrame, k: int = L.SEARCH_TOP_K, threshold: float | None = L.SEARCH_THRESHOLD,
           index_key: str = "id", query_key: str = "query_id", vec: str = "embedding", query_vec: str | None = None,
           max_chunk_bytes: int = DEFAULT_CHUNK_BYTES, block_rows: int = VJ.BLOCK_ROWS,
           round_to: int | None = 4) -> DataFrame:
    """Top-``k`` index rows per query by dot product (cosine on unit vectors).

    Returns ``(query_key, index_key, score, rank)``; ``score >= threshold`` is
    applied on the exact score, and the score is then rounded.
    """
    if index_key == query_key:
        raise ValueError("index_key and query_key must differ")
    spark = index.sparkSession
    query_vec = query_vec or vec
    q = queries.select(query_key, F.col(query_vec).alias("_qv"))
    n, d, fits = _fits_broadcast(q, "_qv", max_chunk_bytes)
    schema = f"{query_key} {_dtype_of(queries, query_key)}, {index_key} {_dtype_of(index, index_key)}, score double"
    if n == 0:
        return spark.createDataFrame([], schema + ", rank int")
    idx = index.select(F.col(index_key), F.col(vec))
    if fits:
        keys, mat = _collect_queries(q, query_key, "_qv", d)
        bk, bm = spark.sparkContext.broadcast(keys), spark.sparkContext.broadcast(mat)

        def run(batches):
            keys_, Q = bk.value, bm.value
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                ids = pdf[index_key].to_numpy()
                for qi, bi, sc in _tiled_topk(Q, _matrix(pdf[vec].to_numpy()), ids, k, threshold):
                    yield pd.DataFrame({query_key: keys_[qi], index_key: ids[bi], "score": sc})

        cand = idx.mapInPandas(run, schema)
    else:
        found = VJ.top_k(idx, q, k, threshold, index_key, query_key, vec, "_qv", block_rows, min(VJ.PIVOT_ROWS, block_rows))
        return found.withColumn("score", F.round("score", round_to)) if round_to is not None else found
    return _merge_topk(cand, query_key, index_key, k, round_to)


def attach_text(hits: DataFrame, index: DataFrame, index_key: str, text_col: str = "text",
                max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Late metadata lookup: join the hit list to the index text by id.

    The hits (queries x k rows) are written once; up to ``max_rows`` of them are
    broadcast so the texts are not shuffled, beyond that both sides are.
    """
    from ..sources.store import checkpoint_table

    h = checkpoint_table(hits.sparkSession, hits, "hits")
    return index.select(index_key, text_col).join(F.broadcast(h) if h.count() <= max_rows else h, index_key, "inner")


def _vector_classes(df: DataFrame, key: str, vec: str, threshold: float):
    """``(classes (v, rep, n), copies)``: one row per distinct vector, and the links of its smallest id to its other rows."""
    from ..sources.store import checkpoint_table

    rows = df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    classes = checkpoint_table(df.sparkSession, rows.groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "vector-classes")
    copies = (rows.join(classes.where("n > 1").select("v", "rep"), "v").where("id <> rep")
              .select(F.col("rep").alias("id1"), F.col("id").alias("id2"),
                      F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("score"))
              .where(F.col("score") >= threshold))
    return classes, copies


def near_duplicates(df: DataFrame, key: str = "id", vec: str = "embedding", threshold: float = L.DUPLICATE_THRESHOLD,
                    block_rows: int = VJ.BLOCK_ROWS, seed: int = L.SEED) -> DataFrame:
    """All near-duplicate links as ``(id1, id2, score)`` with ``id1 < id2``; no neighbour cap.

    Rows with equal vectors form one class; its members are linked to the class's smallest id only. Between classes
    every pair of representatives with a score of ``threshold`` or more is returned (``vector_join.links``).
    """
    return VJ.links(df, key, vec, threshold, block_rows, min(VJ.PIVOT_ROWS, block_rows), seed)


def verdicts(queries: DataFrame, hits: DataFrame, query_key: str, index_key: str, text_col: str | None = None) -> DataFrame:
    """Misinformation verdict per query from its (rounded-score) hits.

    Suspicious when the best score exceeds .90, or when at least 3 hits average
    above .85. A query without hits gets ``false, 0.0, 0, 0.0``. ``similar`` holds
    the hits by rank as ``(id, score, text)``; the text is null without ``text_col``.
    """
    text = F.col(text_col) if text_col else F.lit(None).cast("string")
    agg = hits.groupBy(query_key).agg(
        F.count(F.lit(1)).alias("num_similar"),
        F.max("score").alias("_max"),
        # scores have four places: whole ten-thousandths make the mean and its rounding exact
        (F.sum(F.round(F.col("score") * 10_000)) / F.count(F.lit(1))).alias("_avg4"),
        F.sort_array(F.collect_list(F.struct("rank", F.col(index_key).alias("id"), "score", text.alias("text")))).alias("_hits"))  # at most k per query
    j = queries.select(query_key).join(agg, query_key, "left").withColumn("_avg", F.col("_avg4") / 10_000)
    sus = (F.col("_max") > L.MISINFO_MAX_SUSPICIOUS) | (
        (F.col("num_similar") >= L.MISINFO_MIN_HITS_FOR_AVG) & (F.col("_avg") > L.MISINFO_AVG_SUSPICIOUS))
    has = F.col("num_similar").isNotNull()
    found = F.when(has, F.transform("_hits", lambda h: F.struct(h["id"].alias("id"), h["score"].alias("score"), h["text"].alias("text"))))
    none = F.array().cast(f"array<struct<id:{_dtype_of(hits, index_key)},score:double,text:string>>")
    return j.select(
        query_key,
        F.when(has, sus).otherwise(F.lit(False)).alias("is_suspicious"),
        F.when(has, F.round("_max", 4)).otherwise(F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("num_similar"), F.lit(0)).alias("num_similar"),
        F.when(has, F.round("_avg4") / 10_000).otherwise(F.lit(0.0)).alias("avg_similarity"),
        F.coalesce(found, none).alias("similar"),
        F.when(~has, F.lit(L.REASON_NO_HITS)).when(sus, F.lit(L.REASON_SUSPICIOUS))
        .otherwise(F.lit(L.REASON_ORIGINAL)).alias("reason"),
    )


def _fit_cells(rows: DataFrame, key: str, vec: str, k: int, width: int, seed: int, max_iter: int) -> np.ndarray:
    """Centroids of ``k`` cells by k-means rounds over all rows, from ``k`` rows of a bounded sample by hash.

    A task sends its sums and sizes of cells to a shuffle; a round brings one row a cell to the driver. The library's KMeans
    collects the distances of all pairs of centroids in every round, from as many tasks as there are cells.
    """
    import pyarrow as pa

    spark = rows.sparkSession
    share = math.ceil((1 << 30) * min(1.0, 16 * k / max(1, rows.count())))
    picked = rows.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) < share).select(key, F.col(vec).cast("array<double>").alias("v")).toArrow()
    sample = np.unique(VJ._matrix(picked.column("v").combine_chunks(), width), axis=0)
    centroids = sample[np.random.default_rng(seed).choice(len(sample), min(k, len(sample)), replace=False)]

    def summed(batches):
        C, total, n = shared.value, np.zeros(shared.value.shape), np.zeros(len(shared.value), np.int64)
        for b in batches:
            x = VJ._matrix(b.column(0), width)
            near = _nearest_cells(x, C, 1)[:, 0]
            np.add.at(total, near, x)
            n += np.bincount(near, minlength=len(C))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.array([t.tobytes() for t in total[at]], pa.binary())], ["cell", "n", "total"])

    def added(table: pa.Table) -> pa.Table:
        parts = sorted(table.column("total").to_pylist())  # in a fixed order
        return pa.table({"cell": table.column("cell")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                         "total": pa.array([sum(np.frombuffer(t) for t in parts).tobytes()], pa.binary())})

    schema = "cell int, n long, total binary"
    for _ in range(max_iter):
        shared = spark.sparkContext.broadcast(centroids)
        found = rows.select(F.col(vec).cast("array<double>").alias("v")).mapInArrow(summed, schema).groupBy("cell").applyInArrow(added, schema).collect()
        new = centroids.copy()
        for r in found:
            new[r["cell"]] = np.frombuffer(r["total"]) / r["n"]
        moved = ((new - centroids) ** 2).sum(axis=1).max()
        centroids = new
        if moved <= 1e-8:  # the library's tolerance, squared
            break
    return centroids


def build_ivf(index: DataFrame, key: str = "id", vec: str = "embedding", nlist: int | None = None,
              seed: int = L.SEED, max_iter: int = 20):
    """Cluster the index into ``min(nlist, n // 10)`` cells; returns (index with ``cell``, centroids).

    Without ``nlist`` the number follows the table: one cell for ``IVF_CELL_ROWS`` rows, between the fixed
    number of the source system and ``IVF_MAX_CELLS``.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = index.count()
    nlist = nlist or max(L.IVF_NLIST, min(IVF_MAX_CELLS, n // IVF_CELL_ROWS))
    k = max(1, min(nlist, n // 10))
    width = VJ.vector_width(index, vec)
    if k * k * width >= LOCAL_STATISTICS:
        from ..sources.store import checkpoint_table

        rows = checkpoint_table(index.sparkSession, index.select(key, vec), "ivf-rows")  # read in every round
        centroids = _fit_cells(rows, key, vec, k, width, seed, max_iter)
        return _probes(rows, centroids, key, vec, 1).select(key, vec, "cell"), centroids
    feats = index.select(key, vec, array_to_vector(F.col(vec)).alias("_f"))
    model = KMeans(k=k, seed=seed, featuresCol="_f", predictionCol="cell", maxIter=max_iter).fit(feats)
    cells = model.transform(feats).select(key, vec, F.col("cell").cast("int"))
    centroids = np.array([np.asarray(c, dtype=np.float64) for c in model.clusterCenters()])  # nlist x dim
    return cells, centroids


def _nearest_cells(Q: np.ndarray, C: np.ndarray, nprobe: int) -> np.ndarray:
    """The ``nprobe`` nearest centroids of each row, nearest first, ties by cell; in tiles of ``TILE_BYTES``."""
    out = np.empty((len(Q), nprobe), dtype=np.int64)
    size = (C * C).sum(axis=1)
    height = max(1, TILE_BYTES // (8 * len(C)))
    for a in range(0, len(Q), height):
        d = np.round(size[None, :] - 2 * (Q[a:a + height] @ C.T), SCORE_DECIMALS)  # |q|^2 does not change the order
        near = np.sort(np.argpartition(d, nprobe - 1, axis=1)[:, :nprobe], axis=1)
        order = np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable")
        out[a:a + height] = np.take_along_axis(near, order, axis=1)
    return out


def _probes(queries: DataFrame, centroids: np.ndarray, qkey: str, qvec: str, nprobe: int) -> DataFrame:
    """``(qkey, cell, qvec)``: one row per query and probed cell (centroids broadcast, <= nlist rows)."""
    bc = queries.sparkSession.sparkContext.broadcast(centroids)
    qtype, vtype = _dtype_of(queries, qkey), _dtype_of(queries, qvec)

    def probe(batches):
        C = bc.value
        for pdf in batches:
            if len(pdf) == 0:
                continue
            near = _nearest_cells(_matrix(pdf[qvec].to_numpy()), C, nprobe)
            rep = np.repeat(np.arange(len(pdf)), nprobe)
            yield pd.DataFrame({qkey: pdf[qkey].to_numpy()[rep], "cell": near.reshape(-1).astype(np.int32),
                                qvec: pdf[qvec].iloc[rep].to_numpy()})

    return queries.select(qkey, qvec).mapInPandas(probe, f"{qkey} {qtype}, cell int, {qvec} {vtype}")


def ivf_search(cells: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = L.SEARCH_TOP_K,
               threshold: float | None = L.SEARCH_THRESHOLD, nprobe: int | None = None, index_key: str = "id",
               query_key: str = "query_id", vec: str = "embedding", query_vec: str | None = None,
               max_chunk_bytes: int = DEFAULT_CHUNK_BYTES, block_rows: int = VJ.BLOCK_ROWS,
               round_to: int | None = 4, recall: float = IVF_RECALL) -> DataFrame:
    """Approximate top-k over cells.

    Without ``nprobe`` every query visits the rings of cells that may beat its k-th score, cut where the exact neighbours
    of a sample of queries say that the share ``recall`` of them is reached (``vector_join.top_k``).

    With ``nprobe`` its nearest cells only: a bounded query side is broadcast with an inverted list cell -> probing
    queries; each index batch multiplies, per cell present in the batch, only
    the queries probing that cell with the batch's rows of that cell. A larger
    query side goes through salted blocks per cell. Index rows of a hot cell
    are spread over many tasks either way, and only top-k rows are emitted.
    """
    if nprobe is None:
        length = np.linalg.norm(centroids, axis=1, keepdims=True)
        unit = (centroids / np.maximum(length, 1e-300))[length[:, 0] > 1e-12]
        unit = unit if len(unit) else np.eye(1, centroids.shape[1])
        found = VJ.top_k(cells.select(index_key, vec), queries, k, threshold, index_key, query_key, vec, query_vec, block_rows,
                         pivots=unit, recall=recall)
        return found.withColumn("score", F.round("score", round_to)) if round_to is not None else found
    spark = cells.sparkSession
    query_vec = query_vec or vec
    npr = min(nprobe, len(centroids))
    q = queries.select(query_key, F.col(query_vec).alias("_qv"))
    n, d, fits = _fits_broadcast(q, "_qv", max_chunk_bytes)
    schema = f"{query_key} {_dtype_of(queries, query_key)}, {index_key} {_dtype_of(cells, index_key)}, score double"
    if n == 0:
        return spark.createDataFrame([], schema + ", rank int")
    idx = cells.select(index_key, vec, "cell")
    if fits:
        keys, mat = _collect_queries(q, query_key, "_qv", d)
        near = _nearest_cells(mat, centroids, npr)
        lists = {int(c): np.nonzero((near == c).any(axis=1))[0] for c in np.unique(near)}
        sc = spark.sparkContext
        bk, bm, bl = sc.broadcast(keys), sc.broadcast(mat), sc.broadcast(lists)

        def run(batches):
            keys_, Q, inv = bk.value, bm.value, bl.value
            for pdf in batches:
                if len(pdf) == 0:
                    continue
                ids = pdf[index_key].to_numpy()
                cell = pdf["cell"].to_numpy()
                B = _matrix(pdf[vec].to_numpy())
                for c in np.unique(cell):
                    qs = inv.get(int(c))
                    if qs is None:
                        continue
                    members = np.nonzero(cell == c)[0]
                    for qi, bi, sc in _tiled_topk(Q[qs], B[members], ids[members], k, threshold):
                        yield pd.DataFrame({query_key: keys_[qs][qi], index_key: ids[members][bi], "score": sc})

        cand = idx.mapInPandas(run, schema)
    else:
        cand = _block_topk(idx, _probes(q, centroids, query_key, "_qv", npr), index_key, query_key, vec, "_qv",
                           k, threshold, min(block_rows, DEFAULT_BLOCK_ROWS))
    return _merge_topk(cand, query_key, index_key, k, round_to)


def ivf_near_duplicates(df: DataFrame, key: str = "id", vec: str = "embedding",
                        threshold: float = L.DUPLICATE_THRESHOLD, neighbours: int | None = None,
                        nlist: int | None = None, nprobe: int = L.IVF_NPROBE, block_rows: int = DEFAULT_BLOCK_ROWS,
                        seed: int = L.SEED) -> DataFrame:
    """Near-duplicate pairs over IVF cells, in salted blocks.

    Rows with equal vectors form one class, whose smallest id is linked to its other rows.
    Every class probes its ``nprobe`` nearest cells, and every link of ``threshold`` or more
    that either side finds there is returned. Each (cell, index salt, query salt) group holds
    about ``block_rows`` rows per side, so a hot cell becomes many bounded groups. With
    ``nprobe`` equal to the number of cells the result equals ``near_duplicates``.

    With ``neighbours`` it is a search for each row's best ones: rows are not collapsed, and
    only pairs among the smaller id's ``neighbours`` best (itself included) come out.
    """
    from ..sources.store import checkpoint_table

    spark = df.sparkSession
    if neighbours is None:
        ktype = _dtype_of(df, key)
        classes, copies = _vector_classes(df, key, vec, threshold)
        if classes.isEmpty():
            return spark.createDataFrame([], f"id1 {ktype}, id2 {ktype}, score double")
        df, key, vec = classes.select("rep", "v"), "rep", "v"
    cells, cents = build_ivf(df, key=key, vec=vec, nlist=nlist, seed=seed)
    cells = checkpoint_table(spark, cells, "ivf-cells")  # read several times below
    npr = min(nprobe, len(cents))
    probes = _probes(cells.select(F.col(key).alias("_q"), F.col(vec).alias("_qv")), cents, "_q", "_qv", npr)
    if neighbours is None:
        cand = _block_topk(cells, probes, key, "_q", vec, "_qv", 1 << 30, threshold, block_rows).where(F.col(key) != F.col("_q"))
        links = cand.groupBy(F.least("_q", key).alias("id1"), F.greatest("_q", key).alias("id2")).agg(F.round(F.max("score"), 4).alias("score"))
        return links.unionByName(copies)
    cand = _block_topk(cells, probes, key, "_q", vec, "_qv", neighbours, threshold, block_rows)
    # a (query, row) pair occurs in exactly one (cell, salt) group, so no dedup is needed
    top = _merge_topk(cand, "_q", key, neighbours, None)
    pairs = top.where((F.col(key) > F.col("_q")) & (F.col("score") >= threshold))
    return pairs.select(F.col("_q").alias("id1"), F.col(key).alias("id2"), F.round("score", 4).alias("score"))
