"""Exact vector joins that skip what cannot match: all links above a threshold, and top-k of a large query side.

Rows are dealt to cells: the nearest of at most ``MAX_PIVOTS`` pivots (fitted on a bounded sample), split into
rings by their angle to that pivot (small ones joined). For a row ``x`` and a ring whose rows lie at angles ``lo..hi`` from the pivot and are
no longer than ``m``, every angle between ``x`` and a row of the ring is at least ``max(0, a - hi, lo - a)``, ``a`` being the
angle of ``x`` to the pivot. So ``x`` goes only to rings where ``|x| * m * cos(that angle)`` reaches its threshold. The bound
holds for vectors of any length, and the result is that of scoring all pairs.

* ``links`` -- one threshold for all rows; each pair is looked at from one side only.
* ``top_k`` -- two rounds: the rings around a query's nearest pivots give it a k-th score, and the second round visits
  only other rings whose bound beats that score (or the caller's threshold).

``links`` writes each vector once, in blocks that tasks read in pairs. What ``top_k`` shuffles is a compact form of a vector (``pack``), by shards: runs
of neighbouring cells that together hold a block of rows. A visitor is sent once to a shard with a bit for each of its cells that it visits, so a row is copied at most rows / block times however
many cells there are. A shard of one large cell, or one that many rows visit, is several salted groups. The driver holds
the pivots and a few numbers a cell, both bounded by ``MAX_PIVOTS`` whatever the table's size.
"""

from __future__ import annotations

import hashlib
import math
import struct
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..sources.store import checkpoint_table

MAX_PIVOTS = 256
PIVOT_ROWS = 1_024  # rows a pivot stands for, until there are MAX_PIVOTS
SAMPLE_ROWS = 4_096  # rows the pivots are fitted on
RING = math.pi / 48
CELL_ROWS = 512  # rings of fewer rows are joined with their neighbours
BLOCK_ROWS = 32_768  # rows per side of one group, at most
BLOCK_BYTES = 48 << 20  # of one side's matrix, at most
LEAST_BLOCK_ROWS = 4_096  # a table of fewer than eight such blocks has blocks of an eighth of it, for enough groups
TILE_BYTES = 4 << 20
TILE_WIDTH = 1_024
SLICE_ROWS = 512  # rows that are unpacked or compared with the pivots at a time
MET_VECTORS = 1 << 16  # digests that a task remembers
LINKS_HELD = 1 << 18  # links of a task before they are sent on
VISITORS = 4_096  # rows of a block that are compared with a cell at a time
MANY = 0.004  # of a tile's products, from which all of them are made in double precision
SCORE_DECIMALS = 12  # scores are compared at this precision; ties then go to the smaller id
MAX_BROADCAST_ROWS = 100_000
SLACK = 1e-6  # on angles, against rounding
EPS = 1e-11  # on scores before they are rounded
CALIBRATION = 64  # queries whose exact neighbours set the cut of an approximate search


# --- compact vectors --------------------------------------------------------------------------
HEAD, HEAD_BYTES = "<IBB?x", 8  # non-zero components, how weights are written, length of the table of weights, whether positions are a bit each
DENSE = (1 << 32) - 1
DOUBLES, FLOATS, TABLE = range(3)
LEAST_TABLE = 16  # fewer weights are not worth looking for a table


def _places(width: int) -> type:
    return np.uint16 if width <= 1 << 16 else np.uint32


def pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, without loss: the positions and weights of the non-zero components, or all weights, whichever is shorter.

    Positions are numbers, or a bit for every component where that is shorter. Weights are written as floats where these are
    the same numbers, as a table of the distinct weights and a byte each where that is shorter, else as doubles.
    """
    out = []
    bits = np.packbits(x != 0, axis=1)
    width, place = x.shape[1], _places(x.shape[1])
    with np.errstate(over="ignore"):
        narrow = x.astype(np.float32)
    exact = (narrow == x).all(axis=1)
    for r, count in enumerate(np.count_nonzero(x, axis=1).tolist()):
        at, kind, table = np.flatnonzero(x[r]), DOUBLES, np.zeros(0)
        if exact[r]:
            kind = FLOATS
        elif count >= LEAST_TABLE:
            table, code = np.unique(np.append(x[r, at], 0.0), return_inverse=True)
            code = code.reshape(-1)
            kind = TABLE if len(table) <= 255 and 8 * len(table) + count < 8 * count else DOUBLES
        item = (8, 4, 1)[kind]
        places = min(place().itemsize * count, bits.shape[1])
        dense = item * width < item * count + places
        short = not dense and places < place().itemsize * count
        if kind == TABLE:
            codes = np.full(width, code[-1], np.uint8)
            codes[at] = code[:-1]
            body = table.tobytes() + (codes if dense else codes[at]).tobytes()
        else:
            row = narrow[r] if kind == FLOATS else x[r]
            body = (row if dense else row[at]).tobytes()
        where = b"" if dense else bits[r].tobytes() if short else at.astype(place).tobytes()
        out.append(struct.pack(HEAD, DENSE if dense else count, kind, len(table) if kind == TABLE else 0, short) + body + where)
    return out


def _unpacked_alike(column: pa.Array, width: int) -> np.ndarray | None:
    """The matrix of rows that all are written in full and as the same kind, in one step; else None."""
    if not len(column) or column.type != pa.binary() or column.null_count:
        return None
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    size = int(at[1] - at[0])
    if size not in (HEAD_BYTES + 8 * width, HEAD_BYTES + 4 * width) or (np.diff(at) != size).any():
        return None
    raw = np.frombuffer(column.buffers()[2], np.uint8, size * len(column), int(at[0])).reshape(len(column), size)
    count, kind, _, _ = struct.unpack_from(HEAD, raw[0].tobytes())
    item = {DOUBLES: np.float64, FLOATS: np.float32}.get(kind)
    if count != DENSE or item is None or size != HEAD_BYTES + np.dtype(item).itemsize * width or (raw[:, :HEAD_BYTES] != raw[0, :HEAD_BYTES]).any():
        return None
    return np.ascontiguousarray(raw[:, HEAD_BYTES:]).view(item).astype(np.float64, copy=False)


def unpack(column: pa.Array, width: int) -> np.ndarray:
    """The matrix of packed rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if (alike := _unpacked_alike(column, width)) is not None:
        return alike
    out, place = np.zeros((len(column), width)), _places(width)
    for r, blob in enumerate(column.to_pylist()):
        count, kind, size, short = struct.unpack_from(HEAD, blob)
        n, at = width if count == DENSE else count, HEAD_BYTES
        if kind == TABLE:
            weights = np.frombuffer(blob, np.float64, size, at)[np.frombuffer(blob, np.uint8, n, at + 8 * size)]
            at += 8 * size + n
        else:
            weights = np.frombuffer(blob, np.float32 if kind == FLOATS else np.float64, n, at)
            at += weights.nbytes
        if count == DENSE:
            out[r] = weights
        elif short:
            out[r, np.unpackbits(np.frombuffer(blob, np.uint8, offset=at), count=width).view(bool)] = weights
        else:
            out[r, np.frombuffer(blob, place, n, at)] = weights
    return out


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The matrix of an Arrow list column, from its flat values."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != width).any():
        raise ValueError(f"vectors must all have {width} values")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), width)


def packed(df: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """``(id, v, norm)`` with packed vectors."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            x = _matrix(b.column(1), width) + 0.0  # -0.0 becomes 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pack(x), pa.binary()), pa.array(np.sqrt((x * x).sum(axis=1)))], ["id", "v", "norm"])

    return (df.select(F.col(key).alias("id"), F.col(vec).cast("array<double>").alias("v"))
            .mapInArrow(run, f"id {kind}, v binary, norm double"))


def compact(df: DataFrame, key: str, vec: str, width: int) -> DataFrame:
    """``(key, vec)`` written once with packed vectors; the column's metadata tells their width (``vectors_of`` reads it)."""
    rows = packed(df, key, vec, width).select(F.col("id").alias(key), F.col("v").alias(vec))
    return checkpoint_table(df.sparkSession, rows, "compact-vectors").withMetadata(vec, {"width": width})


def vectors_of(df: DataFrame, vec: str) -> tuple[int, np.ndarray | None]:
    """The width of a packed column, and the weights of its components, if it has any."""
    told = df.schema[vec].metadata
    return told["width"], np.array([float.fromhex(w) for w in told["weights"]]) if "weights" in told else None


def weighted(df: DataFrame, vec: str, weights: list[float]) -> DataFrame:
    """A packed column that is to be multiplied by ``weights`` and brought to unit length wherever it is read (``weigh``)."""
    return df.withMetadata(vec, df.schema[vec].metadata | {"weights": [float(w).hex() for w in weights]})


def weigh(x: np.ndarray, weights: np.ndarray | None) -> np.ndarray:
    """Rows times ``weights`` at unit length (zero rows stay zero); without weights as they are."""
    if weights is None:
        return x
    x = x * weights
    size = np.sqrt(np.cumsum(x * x, axis=1)[:, -1:])  # summed in the order of the components
    return np.where(size > 0, x / np.where(size > 0, size, 1.0), 0.0)


def vector_width(df: DataFrame, vec: str) -> int:
    """The width of the first vector; other widths are an error where they are read."""
    row = df.select(F.size(vec).alias("d")).where("d >= 0").first()
    return row["d"] if row else 0


# --- cells ------------------------------------------------------------------------------------
@dataclass
class Cells:
    """Pivots, and for each cell its pivot, the range of its rows' angles (``l2``: distances) to it, their greatest length, their number and its shard."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray
    rows: np.ndarray
    l2: bool
    shard: np.ndarray

    def plain(self) -> tuple:
        """The fields, for a broadcast: executors may lack the package, whose classes reach them inside the task only."""
        return self.pivots, self.pivot, self.low, self.high, self.norm, self.rows, self.l2, self.shard

    def first(self) -> np.ndarray:
        """The first cell of each shard, and the number of cells."""
        return np.append(np.flatnonzero(np.diff(self.shard, prepend=-1)), len(self.shard))

    def apart(self, x: np.ndarray) -> np.ndarray:
        """Angles or distances between rows and pivots."""
        return distances(x, self.pivots) if self.l2 else _angles(x, self.pivots)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed component by component, so that equal rows are at 0."""
    out = np.zeros((len(q), len(x)))
    for j in range(q.shape[1]):
        out += (q[:, j, None] - x[None, :, j]) ** 2
    return np.sqrt(out)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Angles between rows of any length (a zero row counts as orthogonal) and unit pivots."""
    size = np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)
    return np.arccos(np.clip((x @ pivots.T) / size, -1.0, 1.0))


def fit_centres(sample: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Pivots of a Euclidean search: a few rounds of k-means; ``sample`` is bounded by the caller."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(count, len(sample)), replace=False)]
    for _ in range(rounds):
        near = np.argmin(distances(sample, centres), axis=1)
        total, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(total, near, sample)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


def fit_pivots(sample: np.ndarray, count: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Unit pivots by a few rounds of k-means over directions; ``sample`` is bounded by the caller."""
    size = np.sqrt((sample * sample).sum(axis=1, keepdims=True))
    unit = (sample / np.maximum(size, 1e-300))[size[:, 0] > 0]
    if not len(unit):
        return np.eye(1, sample.shape[1])
    rng = np.random.default_rng(seed)
    pivots = unit[rng.choice(len(unit), min(count, len(unit)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(unit @ pivots.T, axis=1)
        total = np.zeros_like(pivots)
        np.add.at(total, near, unit)
        length = np.sqrt((total * total).sum(axis=1, keepdims=True))
        pivots = np.where(length > 1e-12, total / np.maximum(length, 1e-300), pivots)
    return pivots


def _sample(rows: DataFrame, n: int, width: int, most: int, seed: int) -> np.ndarray:
    """About ``most`` rows, chosen by a hash of the id, as a matrix."""
    share = min(1.0, most / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("v").toArrow()
    return unpack(picked.column("v"), width) if picked.num_rows else np.zeros((0, width))


def rows_of_block(n: int, width: int, most: int = BLOCK_ROWS) -> int:
    """Rows per side of one group: bounded in rows and bytes, and about an eighth of a smaller table."""
    return max(1, min(most, BLOCK_BYTES // (8 * max(1, width)), max(LEAST_BLOCK_ROWS, math.ceil(n / 8))))


def _shards(rows: list[int], most: int) -> np.ndarray:
    """For each cell its shard: neighbouring cells of at most ``most`` rows together; a larger cell alone."""
    out, shard, held = [], -1, math.inf
    for n in rows:
        if held + n > most:
            shard, held = shard + 1, 0
        held += n
        out.append(shard)
    return np.array(out, np.int64)


def build_cells(rows: DataFrame, n: int, width: int, seed: int = L.SEED, pivot_rows: int = PIVOT_ROWS, pivots: np.ndarray | None = None,
                l2: bool = False, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Cells, np.ndarray]:
    """``rows`` with their ``cell`` and ``shard``, the cells' bounds, and the sample of rows; ``pivots`` may be given (unit rows)."""
    spark = rows.sparkSession
    sample = _sample(rows, n, width, SAMPLE_ROWS, seed)
    if pivots is None:
        pivots = (fit_centres if l2 else fit_pivots)(sample, max(1, min(MAX_PIVOTS, math.ceil(n / pivot_rows))), seed)
    rings = math.ceil(math.pi / RING) + 1
    width_of = float(distances(sample, pivots).min(axis=1).max()) / (rings - 1) if l2 and len(sample) else RING
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches):
        for b in batches:
            x = unpack(b.column("v"), width)
            a = distances(x, shared.value) if l2 else _angles(x, shared.value)
            near = np.argmin(a, axis=1)
            own = a[np.arange(len(a)), near]
            ring = near * rings + np.minimum((own / max(width_of, 1e-300)).astype(np.int64), rings - 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ring.astype(np.int32)), pa.array(own)], [*b.schema.names, "ring", "angle"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = checkpoint_table(spark, rows.mapInArrow(place, f"{kinds}, ring int, angle double"), "vector-cells")
    cells, cell_of = _joined_rings(placed, pivots, rings, l2, block_rows)
    names = F.broadcast(spark.createDataFrame([(r, c, int(cells.shard[c])) for r, c in cell_of], "ring int, cell int, shard int"))
    return placed.join(names, "ring").drop("ring", "angle"), cells, sample


def _joined_rings(placed: DataFrame, pivots: np.ndarray, rings: int, l2: bool, block_rows: int) -> tuple[Cells, list[tuple[int, int]]]:
    """The cells of ``placed (ring, angle, norm)``, and the cell of each ring."""
    stats = placed.groupBy("ring").agg(F.min("angle").alias("a"), F.max("angle").alias("b"), F.max("norm").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    # neighbouring rings of a pivot become one cell until it holds CELL_ROWS rows: fewer copies of a row that visits them
    merged: list[list] = []  # pivot, low, high, norm, rows; at most 49 a pivot
    cell_of = []
    for r in sorted(stats, key=lambda r: r["ring"]):
        pivot = r["ring"] // rings
        if not merged or merged[-1][0] != pivot or merged[-1][4] >= CELL_ROWS:
            merged.append([pivot, r["a"], r["b"], r["m"], r["n"]])
        else:
            last = merged[-1]
            last[1:] = [min(last[1], r["a"]), max(last[2], r["b"]), max(last[3], r["m"]), last[4] + r["n"]]
        cell_of.append((r["ring"], len(merged) - 1))
    table = np.array(merged, np.float64).reshape(-1, 5)
    cells = Cells(pivots, table[:, 0].astype(np.int64), table[:, 1], table[:, 2], table[:, 3], table[:, 4].astype(np.int64), l2,
                  _shards([m[4] for m in merged], block_rows))
    return cells, cell_of


def needed(x: np.ndarray, least: np.ndarray, cells: Cells, at: np.ndarray) -> np.ndarray:
    """How well a row of a cell must agree with ``x`` beside the pivot for a product of ``least``: -1 (always) to 1, above 1: never.

    Of ``x`` at angle ``a`` and a row at angle ``b`` from the pivot, the product of unit vectors is ``cos a cos b + u sin a sin b``;
    this is the least ``u`` over the angles of the cell, for every row of ``x`` and every cell of ``at``.
    """
    a = _angles(x, cells.pivots)[:, cells.pivot[at]]
    size = np.sqrt((x * x).sum(axis=1))[:, None] * cells.norm[at][None, :]
    share = least[:, None] / np.maximum(size, 1e-300)
    turn = np.arccos(np.clip(np.cos(a) / np.where(share > 0, share, 1.0), -1.0, 1.0))  # where the need is least
    best = np.full(a.shape, np.inf)
    for b in (cells.low[at][None, :], cells.high[at][None, :], np.clip(turn, cells.low[at], cells.high[at])):
        best = np.minimum(best, (share - np.cos(a) * np.cos(b)) / np.maximum(np.sin(a) * np.sin(b), 1e-12))
    return np.where(least[:, None] <= 0, -1.0, best)


def reachable(x: np.ndarray, least: np.ndarray, cells: Cells, cut: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(row, cell)`` of all cells that may hold a row whose product with ``x`` is ``least`` or more.

    With ``cut`` only cells that ``needed`` at most that much agreement: approximate.
    """
    if cut is not None:
        return np.nonzero(needed(x, least, cells, np.arange(len(cells.rows))) <= cut)
    angle = cells.apart(x)[:, cells.pivot]
    apart = np.maximum(0.0, np.maximum(angle - cells.high, cells.low - angle) - SLACK)
    if cells.l2:  # scores are distances below zero
        return np.nonzero(-apart >= least[:, None])
    size = np.sqrt((x * x).sum(axis=1))[:, None] * cells.norm[None, :]
    # a product of at most zero is never ruled out: zero vectors have no angle
    return np.nonzero((least[:, None] <= 0) | (size * np.cos(np.minimum(apart, math.pi)) >= least[:, None] * (1 - 1e-9)))


# --- blocks -----------------------------------------------------------------------------------
def counted_visits(probes: DataFrame, places: int, by: str = "cell") -> np.ndarray:
    """How many probes visit each cell or shard (one row for each reaches the driver)."""
    out = np.zeros(places, np.int64)
    for r in probes.groupBy(by).count().collect():
        out[r[by]] = r["count"]
    return out


def _scored(probes: DataFrame, cells: Cells) -> int:
    """The number of pairs that probes ask for, from the bits of the cells that they visit."""
    first, rows = cells.first(), cells.rows

    def run(batches):
        for b in batches:
            total = sum(int(np.unpackbits(np.frombuffer(bits, np.uint8))[:first[s + 1] - first[s]] @ rows[first[s]:first[s + 1]])
                        for s, bits in zip(b.column("shard").to_pylist(), b.column("cells").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return probes.select("shard", "cells").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


PROBE = "qv binary, shard int, least double, own int, cells binary"


def _sent(part: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, least: np.ndarray, own: np.ndarray, cells: Cells, first: np.ndarray) -> pa.RecordBatch:
    """One probe for each row of ``part`` and shard that it visits, with a bit for each cell of the shard."""
    wanted = np.zeros((part.num_rows, len(cells.rows)), dtype=bool)
    wanted[row, cell] = True
    at, shard, bits = [], [], []
    for s in np.unique(cells.shard[cell]).tolist():
        some = wanted[:, first[s]:first[s + 1]]
        hit = np.flatnonzero(some.any(axis=1))
        at.append(hit)
        shard.append(np.full(len(hit), s, np.int32))
        bits.extend(b.tobytes() for b in np.packbits(some[hit], axis=1))
    at = np.concatenate(at) if at else np.zeros(0, np.int64)
    take = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [part.column("id").take(take), part.column("v").take(take), pa.array(np.concatenate(shard) if shard else [], pa.int32()),
         pa.array(least[at]), pa.array(own[at].astype(np.int32)), pa.array(bits, pa.binary())], ["q", "qv", "shard", "least", "own", "cells"])


def _tiles(q: np.ndarray, x: np.ndarray, l2: bool = False):
    """``(first query, first row, scores)`` in tiles of at most ``TILE_BYTES``, not rounded; ``l2``: about the squared distances, see ``squares_off``."""
    height = max(1, TILE_BYTES // (8 * max(1, min(len(x), TILE_WIDTH))))
    size = [np.einsum("ij,ij->i", v, v) for v in (q, x)] if l2 else None
    for a in range(0, len(q), height):
        for b in range(0, len(x), TILE_WIDTH):
            s = q[a:a + height] @ x[b:b + TILE_WIDTH].T
            if l2:
                s *= -2
                s += size[0][a:a + height, None]
                s += size[1][b:b + TILE_WIDTH]
            yield a, b, s


def squares_off(q: np.ndarray, x: np.ndarray) -> float:
    """How far the squared distances of ``_tiles`` may be off, at most."""
    most = sum(float(np.einsum("ij,ij->i", v, v).max(initial=0.0)) for v in (q, x))
    return 4 * (q.shape[1] + 4) * np.finfo(np.float64).eps * most


def pair_distances(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of some pairs, the same numbers as those of ``distances``."""
    out = np.zeros(len(i))
    for c in range(q.shape[1]):
        out += (q[i, c] - x[j, c]) ** 2
    return np.sqrt(out)


def _best(at_q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, at_q))
    own = at_q[order]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
    rank = np.arange(len(own)) - np.repeat(first, np.diff(np.append(first, len(own))))
    return order[rank < k]


def _score_block(width: int, k: int | None, l2: bool, first: np.ndarray):
    """Products of one group that reach the query's ``least``; with ``k`` at most that many for each query."""
    def run(rows: pa.Table, probes: pa.Table) -> pa.Table:
        kinds = probes.schema.field("q").type, rows.schema.field("id").type
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        ids = who = np.zeros(0, np.int64)
        if rows.num_rows and probes.num_rows:
            cell = rows.column("cell").to_numpy()
            order = np.argsort(cell, kind="stable")
            cell = cell[order]
            x, q = unpack(rows.column("v"), width)[order], unpack(probes.column("qv"), width)
            ids, who = rows.column("id").to_numpy()[order], probes.column("q").to_numpy()
            least, own = probes.column("least").to_numpy().copy(), probes.column("own").to_numpy()
            start = first[probes.column("shard")[0].as_py()]
            bits = np.unpackbits(np.frombuffer(b"".join(probes.column("cells").to_pylist()), np.uint8).reshape(len(q), -1), axis=1)
            held, most = 0, max(1 << 20, 4 * (k or 0) * len(q))
            off = squares_off(q, x) if l2 else 0.0
            for c in np.unique(cell).tolist():
                visitors = np.flatnonzero(bits[:, c - start])
                low, high = np.searchsorted(cell, [c, c + 1])
                for a, b, s in _tiles(q if len(visitors) == len(q) else q[visitors], x[low:high], l2):
                    me = visitors[a:a + len(s)]
                    near = s <= ((EPS - least[me, None]) ** 2 + off) if l2 else s >= least[me, None] - EPS
                    if k is not None and s.shape[1] > k and np.count_nonzero(near) > 4 * k * len(s):
                        if l2:
                            kth = np.sqrt(np.maximum(np.partition(s, k - 1, axis=1)[:, k - 1, None], 0.0) + off)
                            near &= s <= (kth + EPS) ** 2 + off
                        else:
                            near &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - EPS
                    i, j = np.nonzero(near)
                    score = None if l2 else s[i, j]
                    i, j = me[i], j + low + b
                    # equal vectors may differ in the last bit after a matrix product; rounded, their ties are exact
                    score = np.round(-pair_distances(q, x, i, j) if l2 else score, SCORE_DECIMALS)
                    keep = (score >= least[i]) & ((own[i] != c) | (who[i] < ids[j]))  # inside its own cell a pair is met from both sides
                    found.append((i[keep], j[keep], score[keep]))
                    held += len(found[-1][0])
                    if k is not None and held > most:
                        found = [_merged(found, ids, k, least)]
                        held = len(found[0][0])
            if k is not None and found:
                found = [_merged(found, ids, k, least)]
        join = lambda n, kind, names: pa.array(names[np.concatenate([f[n] for f in found])] if found else [], kind)
        return pa.table({"q": join(0, kinds[0], who), "id": join(1, kinds[1], ids),
                         "score": pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.float64())})
    return lambda left, right: run(left, right)


def _merged(found: list[tuple], ids: np.ndarray, k: int, least: np.ndarray) -> tuple:
    """The ``k`` best of each query so far; ``least`` rises to the k-th score of those that have as many."""
    i, j, score = (np.concatenate(v) for v in zip(*found))
    top = _best(i, score, ids[j], k)
    i, j, score = i[top], j[top], score[top]
    full = np.flatnonzero(np.bincount(i, minlength=len(least)) == k)
    last = np.searchsorted(i, full, "right") - 1
    least[full] = np.maximum(least[full], score[last])
    return i, j, score


def score_blocks(placed: DataFrame, probes: DataFrame, cells: Cells, visits: np.ndarray, width: int, k: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(q, id, score)`` of ``placed (id, v, cell, shard)`` and ``probes (q, qv, shard, least, own, cells)``, shard by shard in salted blocks.

    ``visits``: how many probes a shard has, or about; it only sets the number of its blocks.
    """
    spark = placed.sparkSession
    rows = np.bincount(cells.shard, cells.rows).astype(np.int64)
    blocks = [(s, math.ceil(n / block_rows), max(1, math.ceil(v / block_rows))) for s, (n, v) in enumerate(zip(rows.tolist(), visits.tolist()))]
    sizes = F.broadcast(spark.createDataFrame(blocks, "shard int, n_i int, n_q int"))  # one row a shard
    left = (placed.select("id", "v", "cell", "shard").join(sizes, "shard").withColumn("i", F.pmod(F.xxhash64("id"), F.col("n_i")).cast("int"))
            .withColumn("s", F.explode(F.sequence(F.lit(0), F.col("n_q") - 1))).drop("n_i", "n_q"))
    right = (probes.join(sizes, "shard").withColumn("s", F.pmod(F.xxhash64("q"), F.col("n_q")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_i") - 1))).drop("n_i", "n_q"))
    kinds = probes.schema["q"].dataType.simpleString(), placed.schema["id"].dataType.simpleString()
    return (left.groupBy("shard", "i", "s").cogroup(right.groupBy("shard", "i", "s"))
            .applyInArrow(_score_block(width, k, cells.l2, cells.first()), f"q {kinds[0]}, id {kinds[1]}, score double"))


# --- all links above a threshold ------------------------------------------------------------------
def _placed_vectors(rows: DataFrame, width: int, weights: np.ndarray | None, pivots: np.ndarray) -> DataFrame:
    """``(id, v, norm, same, ring, angle)`` of packed ``rows (id, v)``, written; ``same`` is equal for equal vectors only.

    ``v`` stays empty for a copy of a vector that the task has met with a smaller id: however hot a vector is, a task sends on few of it.
    """
    kind = rows.schema["id"].dataType.simpleString()
    shared, rings = rows.sparkSession.sparkContext.broadcast(pivots), math.ceil(math.pi / RING) + 1

    def run(batches):
        met: dict[bytes, object] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(a, SLICE_ROWS)
                x = weigh(unpack(part.column("v"), width), weights) + 0.0
                same = [hashlib.sha256(row).digest()[:16] for row in x]
                keep = []
                for digest, key in zip(same, part.column("id").to_pylist()):
                    least = met.get(digest)
                    keep.append(least is None or key is None or key <= least)
                    if key is not None and keep[-1]:
                        met[digest] = key
                if len(met) > MET_VECTORS:
                    met.clear()
                angle = _angles(x, shared.value)
                near = np.argmin(angle, axis=1)
                own = angle[np.arange(len(x)), near]
                ring = near * rings + np.minimum((own / RING).astype(np.int64), rings - 1)
                v = part.column("v").take(pa.array(np.arange(len(x)), mask=~np.array(keep, bool)))
                yield pa.RecordBatch.from_arrays([part.column("id"), v, pa.array(np.sqrt((x * x).sum(axis=1))), pa.array(same, pa.binary()),
                                                  pa.array(ring.astype(np.int32)), pa.array(own)], ["id", "v", "norm", "same", "ring", "angle"])

    schema = f"id {kind}, v binary, norm double, same binary, ring int, angle double"
    return checkpoint_table(rows.sparkSession, rows.mapInArrow(run, schema), "vector-cells")


def vector_copies(rows: DataFrame, threshold: float) -> DataFrame | None:
    """The links of the smallest id of each distinct vector to the others' (none: None); ``rows`` have ``same``.

    Only digests and ids are grouped, so a hot vector is a partial aggregate.
    """
    hot = checkpoint_table(rows.sparkSession, rows.groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "equal-vectors")
    if hot.isEmpty():
        return None
    copies = rows.select("id", "norm", "same").join(hot, "same").where("id <> rep")
    score = F.round(F.col("norm") * F.col("norm"), 4)
    return copies.select(F.col("rep").alias("id1"), F.col("id").alias("id2"), score.alias("score")).where(F.col("score") >= threshold)


def _block_written(width: int):
    """One row of a block's rows, in the order of their cells: of equal vectors those of the smallest id only."""
    def run(rows: pa.Table) -> pa.Table:
        ids, same = rows.column("id").to_pylist(), rows.column("same").to_pylist()
        least: dict[bytes, object] = {}
        for digest, key in zip(same, ids):
            if key is not None and (digest not in least or key < least[digest]):
                least[digest] = key
        mine = [key is None or key == least[digest] for digest, key in zip(same, ids)]
        rows = rows.filter(pa.array(mine)).sort_by("cell").combine_chunks()
        bits, values = [], []
        for a in range(0, rows.num_rows, SLICE_ROWS):
            x = unpack(rows.column("v").slice(a, SLICE_ROWS), width)
            bits.append(np.packbits(x != 0, axis=1))
            values.append(x[x != 0])
        value = np.concatenate(values)
        with np.errstate(over="ignore"):
            narrow = value.astype(np.float32)
        value = narrow if (narrow == value).all() else value
        sink = pa.BufferOutputStream()
        fields = pa.schema([("id", rows.schema.field("id").type), ("cell", pa.int32()), ("bits", pa.binary(-(-width // 8)))])
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        with pa.ipc.new_stream(sink, fields, options=options) as out:
            out.write_batch(pa.RecordBatch.from_arrays([rows.column("id").combine_chunks(), rows.column("cell").combine_chunks().cast(pa.int32()),
                                                        pa.FixedSizeBinaryArray.from_buffers(fields.field("bits").type, rows.num_rows, [None, pa.py_buffer(np.concatenate(bits))])], schema=fields))
        with pa.ipc.new_stream(sink, pa.schema([("value", pa.from_numpy_dtype(value.dtype))]), options=options) as out:
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(value)], ["value"]))
        return pa.table({"block": rows.column("block")[:1].cast(pa.int32()), "data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    return lambda rows: run(rows)


def _block_read(data: pa.Buffer, width: int, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.DataType]:
    """Ids, cells and the weighted matrix of a written block, and the type of the ids."""
    source = pa.BufferReader(data)
    with pa.ipc.open_stream(source) as stream:
        rows = stream.read_all().combine_chunks()
    with pa.ipc.open_stream(source) as stream:
        value = stream.read_all().column("value").to_numpy()
    x = np.zeros((rows.num_rows, width))
    bits = np.frombuffer(rows.column("bits").chunk(0).buffers()[1], np.uint8).reshape(rows.num_rows, -1)
    x[np.unpackbits(bits, axis=1, count=width).view(bool)] = value
    for a in range(0, len(x) if weights is not None else 0, SLICE_ROWS):
        x[a:a + SLICE_ROWS] = weigh(x[a:a + SLICE_ROWS], weights)
    return rows.column("id").to_numpy(), rows.column("cell").to_numpy(), x, rows.schema.field("id").type


def _blocks(placed: DataFrame, cells: Cells, cell_of: list[tuple[int, int]], width: int, block_rows: int) -> DataFrame:
    """``(block, data)`` written: each vector once. A shard is a block, a shard of one large cell several; equal vectors share one."""
    spark = placed.sparkSession
    parts = np.maximum(1, -(-np.bincount(cells.shard, cells.rows).astype(np.int64) // block_rows))
    first = np.append(0, np.cumsum(parts))
    names = [(r, c, int(first[cells.shard[c]]), int(parts[cells.shard[c]])) for r, c in cell_of]
    names = F.broadcast(spark.createDataFrame(names, "ring int, cell int, first int, parts int"))
    rows = (placed.where("v is not null").select("id", "v", "same", "ring").join(names, "ring")
            .select("id", "v", "same", "cell", (F.col("first") + F.pmod(F.xxhash64("same"), F.col("parts"))).cast("int").alias("block")))
    written = rows.repartitionById(int(first[-1]), F.col("block")).groupBy("block").applyInArrow(_block_written(width), "block int, data binary")
    return checkpoint_table(spark, written, "vector-blocks")


def _visited(x: np.ndarray, cells: Cells, at: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of ``x`` and cell of ``at`` whether the row must be compared with the cell."""
    pivots, pivot = np.unique(cells.pivot[at], return_inverse=True)
    some = Cells(cells.pivots[pivots], pivot, cells.low[at], cells.high[at], cells.norm[at], cells.rows[at], cells.l2, cells.shard[at])
    out = np.zeros((len(x), len(at)), dtype=bool)
    for a in range(0, len(x), SLICE_ROWS):
        part = x[a:a + SLICE_ROWS]
        row, cell = reachable(part, np.full(len(part), threshold), some)
        out[a + row, cell] = True
    return out


def four_places(score: np.ndarray) -> np.ndarray:
    """Scores of ``SCORE_DECIMALS`` places rounded to 4, halves away from zero as ``F.round`` does."""
    size = np.abs(score)
    small = size < 9_000  # beyond that 12 places are no whole number
    out = ((np.rint(np.where(small, size, 0.0) * 1e12).astype(np.int64) + 50_000_000) // 100_000_000) / 1e4
    for r in np.flatnonzero(~small & np.isfinite(size)).tolist():
        out[r] = float(Decimal(repr(float(size[r]))).quantize(Decimal("0.0001"), ROUND_HALF_UP))
    return np.where(np.isfinite(size), np.copysign(out, score) + 0.0, score)


def _reaching(q: np.ndarray, x: np.ndarray, threshold: float):
    """``(i, j, score)`` of the rows of ``q`` and ``x`` whose product reaches the threshold, tile by tile.

    A tile is first multiplied in single precision. What that cannot rule out, by the bound on its rounding errors, is
    multiplied in double precision: alone, or with the whole tile (and the next one at once) where it is many.
    """
    height = max(1, TILE_BYTES // (8 * max(1, min(len(x), TILE_WIDTH))))
    longest = float(np.sqrt((q * q).sum(axis=1).max(initial=0.0) * (x * x).sum(axis=1).max(initial=0.0)))
    short = longest < 1e12  # also false for NaN
    q32, x32 = (q.astype(np.float32), x.astype(np.float32)) if short else (q, x)
    least = np.float32(threshold - 1.01 * (q.shape[1] + 4) * 2.0 ** -24 * longest - 1e-30) if short else 0.0
    many = not short
    for a in range(0, len(q), height):
        for b in range(0, len(x), TILE_WIDTH):
            part, rows = q[a:a + height], x[b:b + TILE_WIDTH]
            most = MANY * len(part) * len(rows)
            if not many:
                i, j = np.nonzero(q32[a:a + height] @ x32[b:b + TILE_WIDTH].T >= np.nextafter(least, np.float32(-np.inf)))
                many = len(i) > most
                if not many:
                    score = np.einsum("ij,ij->i", part[i], rows[j])
            if many:
                s = part @ rows.T
                i, j = np.nonzero(s >= threshold - EPS)
                score = s[i, j]
                many = not short or len(i) > most
            # equal vectors may differ in the last bit after a matrix product; rounded, their ties are exact
            score = np.round(score, SCORE_DECIMALS)
            keep = score >= threshold
            yield i[keep] + a, j[keep] + b, score[keep]


def _block_links(left: tuple, right: tuple, alone: bool, cells: Cells, threshold: float):
    """``(id1, id2, score)`` of the rows of two blocks, or of one with itself, some at a time."""
    (who, _, q, kind), (ids, cell, x, _) = left, right
    at = np.unique(cell)
    wanted = _visited(q, cells, at, threshold)
    found, held = [], 0

    def out():
        a, b, score = (np.concatenate(v) for v in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(score)], ["id1", "id2", "score"])

    for n, c in enumerate(at.tolist()):
        low, high = np.searchsorted(cell, [c, c + 1])
        every = high if alone else len(q)  # inside a block a pair is met from one side
        visitors = np.flatnonzero(wanted[:every, n])
        if len(visitors) > 0.8 * every:  # a few more than must
            visitors = np.arange(every)
        for a in range(0, len(visitors), VISITORS):
            me = visitors[a:a + VISITORS]
            for i, j, score in _reaching(q[me[0]:me[-1] + 1] if len(visitors) == every else q[me], x[low:high], threshold):
                i, j = me[i], j + low
                one, two = who[i], ids[j]
                keep = (one != two) & (i < j) if alone else one != two
                one, two, score = one[keep], two[keep], four_places(score[keep])
                swap = one > two
                found.append((np.where(swap, two, one), np.where(swap, one, two), score))
                held += len(score)
                if held >= LINKS_HELD:
                    yield out()
                    found, held = [], 0
    if held:
        yield out()


def links(df: DataFrame, key: str, vec: str, threshold: float, block_rows: int = BLOCK_ROWS, pivot_rows: int = PIVOT_ROWS, seed: int = L.SEED,
          report: dict | None = None) -> DataFrame:
    """All pairs ``(id1, id2, score)``, ``id1 < id2``, with a product of ``threshold`` or more.

    ``vec`` is an array, or packed (``compact``), with or without weights. Rows with equal vectors are one class: its members
    are linked to the smallest id only, and classes are compared by that representative. The vectors are written as blocks, each once,
    and a task reads the two blocks (or one) that it compares: nothing is copied for the pairs, so the disk in use follows the rows, not
    the pairs. ``report`` gets the numbers of ``pairs`` there are and that were ``scored``.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    if df.schema[vec].dataType.typeName() == "binary":
        width, weights = vectors_of(df, vec)
        rows = df.select(F.col(key).alias("id"), F.col(vec).alias("v"))
    else:
        width, weights = vector_width(df, vec), None
        rows = checkpoint_table(spark, packed(df, key, vec, width).drop("norm"), "packed-vectors") if width else None
    n = rows.count() if width else 0
    if not n:
        return spark.createDataFrame([], f"id1 {kind}, id2 {kind}, score double")
    block_rows = rows_of_block(n, width, block_rows)
    pivots = fit_pivots(weigh(_sample(rows, n, width, SAMPLE_ROWS, seed), weights), max(1, min(MAX_PIVOTS, math.ceil(n / pivot_rows))), seed)
    placed = _placed_vectors(rows, width, weights, pivots)
    copies = vector_copies(placed, threshold)
    cells, cell_of = _joined_rings(placed.where("v is not null"), pivots, math.ceil(math.pi / RING) + 1, False, block_rows)
    blocks = _blocks(placed, cells, cell_of, width, block_rows)
    a, b = blocks.toDF("a", "va"), blocks.toDF("b", "vb")
    both = a.join(b.hint("shuffle_replicate_nl"), F.col("a") <= F.col("b"))
    shared = spark.sparkContext.broadcast(cells.plain())

    def pairs(batches):
        cells, name, left = Cells(*shared.value), None, None
        for batch in batches:
            for a, va, b, vb in zip(*(batch.column(c) for c in ("a", "va", "b", "vb"))):
                if a.as_py() != name:
                    name, left = a.as_py(), _block_read(va.as_buffer(), width, weights)
                alone = b.as_py() == name
                yield name, left, left if alone else _block_read(vb.as_buffer(), width, weights), alone, cells

    def compared(batches):
        for _, left, right, alone, cells in pairs(batches):
            yield from _block_links(left, right, alone, cells, threshold)

    def scored(batches):
        for _, left, right, alone, cells in pairs(batches):
            at, each = np.unique(right[1], return_counts=True)
            wanted = _visited(left[2], cells, at, threshold)
            if alone:
                wanted &= left[1][:, None] <= at[None, :]
            yield pa.RecordBatch.from_arrays([pa.array([int(wanted.sum(axis=0) @ each)], pa.int64())], ["n"])

    if report is not None:
        n = int(cells.rows.sum())
        report |= {"pairs": n * (n - 1) // 2, "scored": both.mapInArrow(scored, "n long").agg(F.sum("n")).first()[0] or 0}
    found = both.mapInArrow(compared, f"id1 {kind}, id2 {kind}, score double")
    return found if copies is None else found.unionByName(copies)


# --- top-k of a large query side ----------------------------------------------------------------------
def _nearest(x: np.ndarray, cells: Cells, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(row, cell)`` of the cells of each row's nearest pivots, as many as hold ``4 * k`` rows."""
    each = np.bincount(cells.pivot, cells.rows, len(cells.pivots))
    order = np.argsort(cells.apart(x), axis=1, kind="stable")
    before = np.cumsum(each[order], axis=1) - each[order]
    near = np.zeros((len(x), len(cells.pivots)), dtype=bool)
    row, place = np.nonzero(before < 4 * k)
    near[row, order[row, place]] = True
    return np.nonzero(near[:, cells.pivot])


def _kth_calibrated(hits: DataFrame, first: DataFrame, placed: DataFrame, asked: DataFrame, cells: Cells, width: int, k: int, floor: float, recall: float) -> float:
    """The agreement up to which cells must be visited so that this share of the true neighbours lies in them.

    Measured on exact ``hits`` of a bounded set of queries: a neighbour found in the first round needs none.
    """
    kth = first.where(F.col("rank") == k).select("q", F.col("score").alias("kth"))
    where = (hits.join(placed.select("id", "cell"), "id").join(kth, "q", "left").join(asked.select(F.col("id").alias("q"), "v"), "q")
             .select("v", "cell", "kth").toArrow())  # CALIBRATION queries * k rows
    if not where.num_rows:
        return 1.0
    x = unpack(where.column("v"), width)
    least = np.maximum(floor, where.column("kth").combine_chunks().fill_null(-math.inf).to_numpy(zero_copy_only=False))
    cell = where.column("cell").to_numpy()
    need = np.array([-1.0 if c in set(_nearest(x[r:r + 1], cells, k)[1].tolist()) else needed(x[r:r + 1], least[r:r + 1], cells, np.array([c]))[0, 0]
                     for r, c in enumerate(cell.tolist())])
    return float(np.quantile(need, recall, method="higher")) + SLACK


def top_k(index: DataFrame, queries: DataFrame, k: int, threshold: float | None = None, index_key: str = "id", query_key: str = "query_id",
          vec: str = "embedding", query_vec: str | None = None, block_rows: int = BLOCK_ROWS, pivot_rows: int = PIVOT_ROWS, seed: int = L.SEED,
          pivots: np.ndarray | None = None, recall: float | None = None, report: dict | None = None, l2: bool = False) -> DataFrame:
    """``(query_key, index_key, score, rank)``: the ``k`` rows of the greatest product for each query; ``l2``: of the least distance, scored below zero.

    Exact, unless ``recall`` is given: then the second round visits only the cells that, measured on the exact
    neighbours of ``CALIBRATION`` queries, hold that share of them. ``pivots``: unit rows to use instead of fitted ones.
    ``report`` gets the numbers of ``pairs`` there are and that were ``scored`` in both rounds, and the ``cut`` in use.
    """
    spark = index.sparkSession
    ikind, qkind = index.schema[index_key].dataType.simpleString(), queries.schema[query_key].dataType.simpleString()
    width = vector_width(index, vec)
    if not width:
        return spark.createDataFrame([], f"{query_key} {qkind}, {index_key} {ikind}, score double, rank int")
    rows = checkpoint_table(spark, packed(index, index_key, vec, width), "index-vectors")
    asked = checkpoint_table(spark, packed(queries, query_key, query_vec or vec, width), "query-vectors")
    n = rows.count()
    block_rows = rows_of_block(n, width, block_rows)
    placed, cells, _ = build_cells(rows, n, width, seed, pivot_rows, pivots, l2, block_rows)
    shards = int(cells.shard.max(initial=-1)) + 1
    shared = spark.sparkContext.broadcast(cells.plain())
    floor = -math.inf if threshold is None else threshold

    def visits(second: bool, cut: float | None = None):
        def run(batches):
            cells = Cells(*shared.value)
            first = cells.first()
            for b in batches:
                for a in range(0, b.num_rows, 512):
                    part = b.slice(a, 512)
                    x = unpack(part.column("v"), width)
                    row, cell = _nearest(x, cells, k)
                    least = np.full(len(x), floor)
                    if second:
                        least = np.maximum(floor, part.column("kth").fill_null(-math.inf).to_numpy(zero_copy_only=False))
                        seen = np.zeros((len(x), len(cells.rows)), dtype=bool)
                        seen[row, cell] = True
                        row, cell = reachable(x, least, cells, cut)
                        new = ~seen[row, cell]
                        row, cell = row[new], cell[new]
                    yield _sent(part, row, cell, least, np.full(len(x), -1), cells, first)
        return run

    schema = f"q {qkind}, {PROBE}"
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("id"))
    ranked = lambda hits: hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first_probes = checkpoint_table(spark, asked.mapInArrow(visits(False), schema), "first-visits")  # counted by cell, then sent
    first_count = counted_visits(first_probes, shards, "shard")
    first = checkpoint_table(spark, ranked(score_blocks(placed, first_probes, cells, first_count, width, k, block_rows)), "first-hits")
    kth = first.where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("score").alias("kth"))

    def both_rounds(some: DataFrame, hits: DataFrame, cut: float | None) -> tuple[DataFrame, DataFrame]:
        probes = checkpoint_table(spark, some.mapInArrow(visits(True, cut), schema), "second-visits")
        count = counted_visits(probes, shards, "shard")
        return probes, ranked(hits.drop("rank").unionByName(score_blocks(placed, probes, cells, count, width, k, block_rows)))

    known = asked.select("id", "v").join(kth, "id", "left")
    cut = None
    if recall is not None:
        share = F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)) < math.ceil((1 << 30) * min(1.0, CALIBRATION / max(1, asked.count())))
        some = checkpoint_table(spark, known.where(share), "calibration")
        _, exact = both_rounds(some, first.join(some.select(F.col("id").alias("q")), "q", "left_semi"), None)
        cut = _kth_calibrated(exact, first, placed, asked, cells, width, k, floor, recall)
    second_probes, found = both_rounds(known, first, cut)
    if report is not None:
        report |= {"pairs": n * asked.count(), "scored": _scored(first_probes, cells) + _scored(second_probes, cells), "cut": cut}
    return found.select(F.col("q").alias(query_key), F.col("id").alias(index_key), "score", "rank")
