"""Periodic runs of words by scale-tiled distribution (operator 13).

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart
are identical), of ``max(min_length, 2 * q)`` words or more, that no neighbouring word
extends keeping the period. ``find_runs`` returns them all, whatever their period.

Method. Periods are taken by octave, ``[2**j, 2**(j+1))`` (the smallest periods share one
scale). The words ``i`` with ``word[i] == word[i + p]`` of a run form an interval of at
least the stride of its octave, so it covers one of the boundaries that lie a stride apart.
Around a boundary a tile holds a few octaves of words; one Z-function from the boundary
to the right gives for every period how far the match goes, and the words before it how far
back. Both are cut at the tile's edge, so a longer run comes out as overlapping fragments, one
for each boundary it covers. A period whose word block is a power of a shorter block is dropped
at the boundary (its run has the shorter period), so fragments stay few on constant text too.

A document of more than ``TILE`` words is exploded: overlapping pieces of its word numbers,
all small octaves in one series of pieces and each large octave in a series of its own, are
dealt over all tasks and solved there. A document that is one piece is solved where it is read.
Fragments ``(document, period, start, stop)`` are then shuffled by document and period and
stitched where they touch or overlap; intervals that are long enough are the runs.

Words are compared by 64-bit hashes. Memory: one document, or one piece; a piece of octave ``j`` holds
about ``10 * 2**j`` words, so the largest is a few times its document.

Defined results: null, empty or wordless text: no words, no runs. Very long texts are cut into
pieces as above, never short. Each input row gives one row, also when ids repeat, tie or are null.
An empty table gives an empty table. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import saved
from .words import SPACE, U, mix, text_runs, word_hashes, word_spans

TILE = 16_384  # words of a piece before its overlap
MIN_LENGTH = 12
EIGHT = 8  # words compared for all candidates of a boundary at once
CELLS = 1 << 20  # comparisons held at once


class Octave:
    """Periods ``low <= p < high``, boundaries ``stride`` apart, matches followed for ``reach`` words."""

    def __init__(self, low: int, high: int, min_length: int):
        self.low, self.high = low, high
        self.stride = max(1, min(max(p, min_length - p) for p in (low, max(low, min(high - 1, min_length // 2)), high - 1)))
        self.reach = max(2 * self.stride, 2 * EIGHT, high)
        self.right = self.reach + high  # words that a tile needs from its boundary on


def octaves(words: int, min_length: int) -> list[Octave]:
    """The scales of a text: periods up to half its words."""
    out, low, high = [], 1, 8
    while 2 * low <= words:
        out.append(Octave(low, high, min_length))
        low, high = high, 2 * high
    return out


@lru_cache(maxsize=1 << 16)
def _smaller_powers(p: int) -> tuple[int, ...]:
    """``p / r`` for each prime ``r`` of ``p``."""
    out, rest, r = [], p, 2
    while r * r <= rest:
        if rest % r == 0:
            out.append(p // r)
            while rest % r == 0:
                rest //= r
        r += 1
    return tuple(out + [p // rest] * (rest > 1))


def _steps(w: np.ndarray, i: np.ndarray, j: np.ndarray, by: int) -> np.ndarray:
    """How many of the first ``EIGHT`` words from ``i`` and from ``j`` on (``by`` 1 or -1) agree."""
    out, live = np.zeros(len(i), np.int64), np.arange(len(i))
    for k in range(EIGHT):
        live = live[w[i[live] + by * k] == w[j[live] + by * k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _agree(x: np.ndarray, i: int, j: int) -> int:
    """How far ``x[i:]`` and ``x[j:]`` agree (``i < j``), compared in growing pieces."""
    n, step = 0, 64
    while j + n < len(x):
        m = min(step, len(x) - j - n)
        bad = np.flatnonzero(x[i + n:i + n + m] != x[j + n:j + n + m])
        if len(bad):
            return n + int(bad[0])
        n, step = n + m, 2 * step
    return n


def boundary_z(x: np.ndarray, most: int) -> np.ndarray:
    """``z[o]`` for ``0 <= o < most``: how far ``x[o:]`` agrees with ``x``, the Z-function of a tile from its boundary.

    Offsets that agree in fewer than ``EIGHT`` words are settled together; the others in ascending order by the
    usual box of the match that reaches farthest, so that no word is compared twice beyond it.
    """
    z = np.zeros(max(1, most), np.int64)
    z[0] = len(x)
    at = np.flatnonzero(x[1:most] == x[0]) + 1
    padded = np.concatenate((x, np.arange(EIGHT, dtype=x.dtype) - x.dtype.type(EIGHT + 1)))  # the padding agrees with nothing at these distances
    z[at] = np.minimum(_steps(padded, np.zeros(len(at), np.int64), at, 1), len(x) - at)
    left = right = 0
    for o in at[z[at] >= EIGHT].tolist():
        known = min(int(z[o - left]), right - o) if o < right else 0
        if known < right - o:
            z[o] = known
            continue
        z[o] = known = known + _agree(x, known, o + known)
        if o + known > right:
            left, right = o, o + known
    return z


def fragments(w: np.ndarray, scales: list[Octave], starts: list[np.ndarray], min_length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(period, start, stop)`` arrays of the matching intervals seen from the given boundaries of each octave.

    ``stop`` is the word after the last ``i`` with ``w[i] == w[i + period]``. Intervals that end inside their tile
    and are too short for a run are left out.
    """
    pad = max([s.right for s in scales], default=0) + EIGHT
    fill = np.arange(pad, dtype=w.dtype) - w.dtype.type(pad + 1)  # agrees with no word and not with itself
    padded = np.concatenate((fill[:EIGHT], w, fill))
    for scale, c in zip(scales, starts):
        width, out = scale.high - scale.low, []
        need = np.maximum(np.arange(scale.low, scale.high), min_length - np.arange(scale.low, scale.high))
        view = np.lib.stride_tricks.sliding_window_view(padded, width)
        rows = max(1, CELLS // width)
        for a in range(0, len(c), rows):
            at = c[a:a + rows] + EIGHT
            b, p = np.nonzero(view[at + scale.low] == padded[at][:, None])
            if not len(b):
                continue
            i = at[b]
            j = i + p + scale.low
            ahead = _steps(padded, i, j, 1)
            back = _steps(padded, i - 1, j - 1, -1)
            good = (ahead >= EIGHT) | (back >= EIGHT) | (ahead + back >= need[p])
            i, p = i[good] - EIGHT, p[good] + scale.low
            if not len(i):
                continue
            cut = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))).tolist() + [len(i)]
            for x, y in zip(cut[:-1], cut[1:]):
                out += _at_boundary(w, int(i[x]), p[x:y].tolist(), scale, min_length)
        if out:
            period, start, stop = (np.array(v, np.int64) for v in zip(*out))
            yield period, start, stop


def _at_boundary(w: np.ndarray, c: int, periods: list[int], scale: Octave, min_length: int) -> list[tuple[int, int, int]]:
    z = boundary_z(w[c:c + scale.right], scale.high)
    from_ = max(0, c - scale.reach)
    out = []
    for p in periods:
        if any(z[q] >= p - q for q in _smaller_powers(p)):
            continue  # the block is a power: the run has a shorter period
        ahead = min(int(z[p]), scale.reach)
        bad = np.flatnonzero(w[from_:c] != w[from_ + p:c + p])
        back = c - from_ - (int(bad[-1]) + 1 if len(bad) else 0)
        whole = ahead < scale.reach and back < scale.reach
        if whole and ahead + back < max(p, min_length - p):
            continue
        if back >= scale.stride and ahead <= scale.reach - scale.stride:
            continue  # the boundary before sees all of it
        out.append((p, c - back, c + ahead))
    return out


def _pieces(n: int, min_length: int) -> Iterator[tuple[list[int], int, int, int, int]]:
    """``(octaves, first boundary word, end, from word, to word)`` of the pieces of a text of ``n`` words.

    One piece for all octaves where the text fits a tile; else a series of pieces for the octaves whose tiles are far
    smaller than ``TILE``, and one series for each larger octave.
    """
    scales = octaves(n, min_length)
    if n <= TILE:
        yield list(range(len(scales))), 0, n, 0, n
        return
    small = [k for k, s in enumerate(scales) if s.reach + s.right <= TILE // 2]
    for group in ([small] if small else []) + [[k] for k in range(len(scales)) if k not in small]:
        s = scales[group[-1]]
        core = max(TILE, 4 * s.high)
        for a in range(0, n, core):
            end = min(n, a + core)
            yield group, a, end, max(0, a - s.reach), min(n, end + s.right)


def _solve(w: np.ndarray, group: list[int], first: int, end: int, offset: int, n: int, min_length: int):
    """Fragments of one piece: words ``w`` from word ``offset`` of a text of ``n`` words, boundaries in ``[first, end)``."""
    scales = [octaves(n, min_length)[k] for k in group]
    starts = [np.arange(-(-first // s.stride) * s.stride, end, s.stride) - offset for s in scales]
    for period, start, stop in fragments(w, scales, starts, min_length):
        yield period, start + offset, stop + offset


READ = "row long, doc_id {}, n long, text string, suspect boolean, frag_period array<long>, frag_start array<long>, frag_stop array<long>, pieces array<struct<octaves:array<int>,first:long,end:long,offset:long,words:binary>>"


def _blank_joined(data: np.ndarray, offs: np.ndarray, en: np.ndarray, first: np.ndarray) -> pa.Array:
    """The words of each text, joined by single blanks."""
    keep = np.append(SPACE[data], False)
    out = np.append(data, np.uint8(0))
    last = np.zeros(len(en), dtype=bool)
    last[first[1:][np.diff(first) > 0] - 1] = True
    between = en[~last]
    keep[between], out[between] = True, 32
    ends = np.concatenate(([0], np.cumsum(keep)))[offs]
    return pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer((ends - ends[0]).astype(np.int32).tobytes()), pa.py_buffer(out[keep].tobytes()))


def _read(min_length: int):
    """One row a document: its words, and either its fragments or its pieces."""
    def lists(groups):
        flat = np.concatenate(groups) if groups else np.zeros(0, np.int64)
        offs = np.concatenate(([0], np.cumsum([len(g) for g in groups])))
        return pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, pa.int64()))

    piece = pa.struct([("octaves", pa.list_(pa.int32())), ("first", pa.int64()), ("end", pa.int64()), ("offset", pa.int64()), ("words", pa.binary())])

    def run(batches):
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            for i, j, data, offs in text_runs(b.column(1)):
                _, st, en, first = word_spans(data, offs, SPACE)
                h = word_hashes(data, st, en)
                count = np.diff(first)
                doc = np.repeat(np.arange(j - i), count)
                ids = mix(h ^ (doc.astype(U) * U(0x9E3779B97F4A7C15))).astype(np.int64)  # a word differs from document to document
                n_of, begin = count[doc] if len(doc) else count[:0], first[:-1][doc] if len(doc) else first[:0]
                place = np.arange(len(h)) - begin
                inside = n_of <= TILE
                scales = octaves(int(n_of[inside].max()) if inside.any() else 0, min_length)
                starts = [np.flatnonzero(inside & (place % s.stride == 0) & (n_of >= max(min_length, 2 * s.low))) for s in scales]
                found = list(fragments(ids, scales, starts, min_length))
                period, start, stop = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (zip(*found) if found else ([], [], [])))
                owner = doc[start] if len(start) else np.zeros(0, np.int64)
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(j - i + 1))
                parts = [order[x:y] for x, y in zip(cut[:-1], cut[1:])]
                pieces = []
                for r in range(j - i):
                    a, z = int(first[r]), int(first[r + 1])
                    n, own = z - a, []
                    if n > TILE:
                        number = np.unique(h[a:z], return_inverse=True)[1].astype(np.int32)
                        own = [{"octaves": g, "first": f, "end": e, "offset": o, "words": number[o:t].tobytes()} for g, f, e, o, t in _pieces(n, min_length)]
                    pieces.append(own)
                shift = first[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + j - i), pa.int64()), b.column(0).slice(i, j - i), pa.array(count, pa.int64()), _blank_joined(data, offs, en, first),
                     pa.array([bool(len(p)) or bool(q) for p, q in zip(parts, pieces)], pa.bool_()),
                     lists([period[p] for p in parts]), lists([start[p] - s for p, s in zip(parts, shift)]), lists([stop[p] - s for p, s in zip(parts, shift)]),
                     pa.array(pieces, pa.list_(piece))],
                    ["row", "doc_id", "n", "text", "suspect", "frag_period", "frag_start", "frag_stop", "pieces"])
                at += j - i
    return run


def _solve_rows(min_length: int):
    def run(batches):
        for b in batches:
            got = {c: b.column(c) for c in ("row", "n", "octaves", "first", "end", "offset", "words")}
            for r in range(b.num_rows):
                x = {c: v[r].as_py() for c, v in got.items()}
                w = np.frombuffer(x["words"], np.int32).astype(np.int64)
                for period, start, stop in _solve(w, x["octaves"], x["first"], x["end"], x["offset"], x["n"], min_length):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(period), x["row"]), pa.int64()), *(pa.array(v, pa.int64()) for v in (period, start, stop))],
                                                     ["row", "period", "start", "stop"])
    return run


def stitch(found: DataFrame, min_length: int) -> DataFrame:
    """Runs ``(row, start, length, period)`` of fragments ``(row, period, start, stop)``: touching or overlapping ones are one interval."""
    order = Window.partitionBy("row", "period").orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") > F.coalesce("before", F.lit(-1)), 1).otherwise(0)).over(order)
    whole = (found.withColumn("before", before).withColumn("island", island).groupBy("row", "period", "island")
             .agg(F.min("start").alias("start"), F.max("stop").alias("stop")))
    size = F.col("stop") - F.col("start")
    return whole.where(size >= F.greatest("period", F.lit(min_length) - F.col("period"))).select("row", "start", (size + F.col("period")).alias("length"), "period")


RUNS = "array<struct<start:long,length:long,period:long>>"


def _collapse(batches):
    """Texts without the words that a run holds after its first period."""
    for b in batches:
        runs, texts = b.column("runs"), []
        for r, text in enumerate(b.column("text").to_pylist()):
            start, length, period = (runs[r].values.field(c).to_numpy() for c in ("start", "length", "period"))
            if len(start):
                words = text.split(" ")
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, start + period, 1)
                np.add.at(depth, start + length, -1)
                text = " ".join(words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist())
            texts.append(text)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n"), runs, pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, min_length: int = MIN_LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, runs, collapsed)``, one row a document.

    ``runs``: ``array<struct<start, length, period>>`` by start, then period. ``collapsed``: the words joined by single
    blanks, without the words that any run holds after its first period.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    read = (docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
            .mapInArrow(_read(min_length), READ.format(kind)))
    read = saved(read, "periodic-words")
    near = (read.where(F.size("frag_period") > 0)
            .select("row", F.explode(F.arrays_zip(F.col("frag_period").alias("period"), F.col("frag_start").alias("start"), F.col("frag_stop").alias("stop"))).alias("f"))
            .select("row", "f.*"))
    dealt = read.where(F.size("pieces") > 0).select("row", "n", F.explode("pieces").alias("p")).select("row", "n", "p.*")
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    far = dealt.mapInArrow(_solve_rows(min_length), "row long, period long, start long, stop long")
    runs = (stitch(near.unionByName(far), min_length).groupBy("row")
            .agg(F.array_sort(F.collect_list(F.struct("start", "length", "period"))).alias("runs")))
    out = f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string"
    cut = (read.where("suspect").select("row", "doc_id", "n", "text").join(runs, "row", "left")
           .select("doc_id", "n", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"), "text").mapInArrow(_collapse, out))
    plain = read.where("not suspect").select("doc_id", F.col("n").alias("n_words"), F.array().cast(RUNS).alias("runs"), F.col("text").alias("collapsed"))
    return cut.unionByName(plain)
