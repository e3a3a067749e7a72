"""Prefix trie of conversations by truncation peeling (operator 12).

Every distinct sequence of the first ``d`` turns of a conversation is a node of depth ``d``; the root
(depth 0) has no turn. ``prefix_trie`` returns one row a node with its members and subtree sums.

Method. Equal conversations are collapsed first (a partial aggregate, so a hot one is a single row), and
the distinct ones are range partitioned by their path, the 128-bit digests of their turns one after the
other. A partition is then a stretch of the trie. Each is peeled from its greatest depth: conversations that end
at the depth join the surviving nodes, equal prefixes are grouped (neighbours, as the rows are sorted), the
group's sums are made, the last turn is stripped, and the depth above is next, so nodes are found and
aggregated in one pass. Nodes that hold neither the first nor the last row of a partition are whole. The others, at most one
path on either edge, keep the sums of what hangs on them beside the open path and go on as one
``spine`` row a path. Spines are sorted and peeled in the same way, ``FAN`` to a partition, until one partition
is left. So there are a few jobs whatever the depth, no key is gathered in one task, and a hot prefix is spread over
the partitions like any other stretch.

Memory: the paths of one partition (``ROWS`` conversations or ``TURNS`` turns). A conversation is one row.

Defined results: turns without a conversation id take no part. Null role or text count as empty ones. Null
positions come first; turns of one conversation with equal positions are ordered by their digest, and repeated rows
are turns like others. Very long texts only count by digest and length. An empty table has no node, not even a
root. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import saved

WIDTH = 16  # bytes of a turn's digest
ROWS = 4_000  # distinct conversations of a partition
TURNS = 50_000  # turns of a partition
FAN = 256  # spines peeled together

ENTRY = "array<struct<depth:int,n:long,low:long,kids:long,leaves:long,saved:long,ended:long>>"
PATH = f"path binary, sizes array<long>, entries {ENTRY}"
NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ended long, node_key binary, parent_key binary")
OUT_NAMES = [x.split(" ")[0] for x in NODE.split(", ")] + ["path", "sizes", "entries"]
BROADCAST_ROWS = 100_000
NONE = np.iinfo(np.int64).max  # no id


def turn_digest(role: Column, text: Column) -> Column:
    """Hex digest of a turn; the role's length keeps ('a', 'bc') and ('ab', 'c') apart."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.md5(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t))


def paths(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``(conv_id, path, sizes)`` of turns ``(conv_id, place, digest, size)``.

    ``place`` is any sortable value, nulls first. Conversations without turns come from ``conversations (conv_id)``.
    """
    one = turns.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        F.col("place").isNotNull().alias("a"), F.col("place").alias("b"), "digest", "size"))).alias("t"))
    out = one.select("conv_id", F.unhex(F.array_join("t.digest", "")).alias("path"), F.col("t.size").cast("array<long>").alias("sizes"))
    if conversations is None:
        return out
    rest = conversations.where("conv_id is not null").select("conv_id").distinct().join(one.select("conv_id"), "conv_id", "left_anti")
    return out.unionByName(rest.select("conv_id", F.unhex(F.lit("")).alias("path"), F.array().cast("array<long>").alias("sizes")))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    n = min(len(a), len(b))
    x = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
    return (int(np.argmax(x)) if x.any() else n) // WIDTH


class _Sums:
    """Sums of the nodes of one depth, by ascending first row."""

    FIELDS = ("row", "n", "low", "kids", "leaves", "saved", "ended")

    def __init__(self, *columns):
        self.__dict__.update(zip(self.FIELDS, columns))


def peel(path: list[bytes], size: np.ndarray, offs: np.ndarray, cols: np.ndarray, last: bool, spined: bool):
    """Peel sorted paths from the greatest depth to the root: ``(node columns of each depth, spines)``.

    ``size[offs[i]:]`` are the text lengths of path ``i``; ``cols`` are rows ``(depth, path, n, low, kids, leaves, saved,
    ended)`` of sums that hang on a node of a path: a conversation has one, at its end. With ``last`` every node is whole;
    else the nodes of the first and of the last path stay open and come out as spines ``{path: columns}``.
    """
    rows = len(path)
    lcp = np.array([-1] + [_common(path[i - 1], path[i]) for i in range(1, rows)], np.int64)
    cols = cols[np.lexsort((cols[:, 1], cols[:, 0]))]
    deepest = int(cols[-1, 0])
    starts = np.searchsorted(cols[:, 0], np.arange(deepest + 2))
    none = np.zeros(0, np.int64)
    above, open_row, open_edge = _Sums(*[none] * 7), none, none  # what survives of the depth below: whole nodes, open nodes
    levels, spines = [], {0: [], rows - 1: []}
    for d in range(deepest, -1, -1):
        own = _Sums(*cols[starts[d]:starts[d + 1], 1:].T)
        # newly ended conversations (or the sums of a spine) meet the surviving nodes, now without their last turn
        row = np.concatenate((above.row, own.row, open_row))
        order = np.argsort(row, kind="stable")
        ordered = row[order]
        start = lcp[ordered] < d
        start[1:] &= ordered[1:] != ordered[:-1]
        group = np.empty(len(row), np.int64)
        group[order] = np.cumsum(start) - 1
        m = int(start.sum())
        first = ordered[start]
        a, b, c = np.split(group, [len(above.row), len(above.row) + len(own.row)])

        def total(x, y, into=(a, b), m=m):
            out = np.zeros(m, np.int64)
            np.add.at(out, into[0], x)
            np.add.at(out, into[1], y)
            return out

        n, kids = total(above.n, own.n), total(np.ones(len(a), np.int64), own.kids)
        leaves, saved_ = total(above.leaves, own.leaves), total(above.saved, own.saved)
        low, ended = np.full(m, NONE), np.full(m, NONE)
        np.minimum.at(low, a, above.low)
        np.minimum.at(low, b, own.low)
        np.minimum.at(ended, b, own.ended)
        edge = np.zeros(m, np.int64)  # 1: has the first path, 2: the last, 3: both
        if not last:
            np.bitwise_or.at(edge, c, open_edge)
            np.bitwise_or.at(edge, b, (own.row == 0) + 2 * (own.row == rows - 1))
        whole, torn = np.flatnonzero(edge == 0), np.flatnonzero(edge)
        if len(a):  # the parents of the whole nodes below are known now, unless they are open
            levels[-1]["parent"] = np.where(edge[a] == 0, low[a], NONE)
            keys = {g: _key(path, first[g], d) for g in torn.tolist()}
            levels[-1]["parent_key"] = [keys.get(g) for g in a.tolist()]
        for g in torn.tolist():
            spines[0 if edge[g] & 1 else rows - 1].append((d, n[g], low[g], kids[g], leaves[g], saved_[g], ended[g]))
        leaves = np.where(kids == 0, 1, leaves)
        if d:
            saved_ = saved_ + (n - 1) * size[offs[first] + d - 1]
        above = _Sums(first[whole], n[whole], low[whole], kids[whole], leaves[whole], saved_[whole], ended[whole])
        open_row, open_edge = first[torn], edge[torn]
        levels.append({"depth": d, "sums": above, "parent": np.full(len(whole), NONE), "parent_key": [None] * len(whole),
                       "key": [_key(path, r, d) if spined else None for r in above.row.tolist()]})
    return levels, {at: np.array(s, np.int64) for at, s in spines.items() if s}


def _key(path: list[bytes], row: int, depth: int) -> bytes:
    return hashlib.md5(path[row][:WIDTH * depth]).digest()


def _peel_rows(last: bool, spined: bool):
    """Peel one sorted partition: rows of nodes, and of spines (those have a path)."""
    entry = pa.struct([("depth", pa.int32()), *((c, pa.int64()) for c in ("n", "low", "kids", "leaves", "saved", "ended"))])

    def ids(x):
        return pa.array(x, pa.int64(), mask=x == NONE)

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        path = table.column("path").to_pylist()
        sizes, own = (table.column(c).combine_chunks() for c in ("sizes", "entries"))
        offs = np.concatenate(([0], np.cumsum(sizes.value_lengths().to_numpy(zero_copy_only=False))))
        size, flat = sizes.flatten().to_numpy(zero_copy_only=False), own.flatten()
        at = np.repeat(np.arange(len(path)), own.value_lengths().to_numpy(zero_copy_only=False))
        get = lambda c: flat.field(c).fill_null(NONE if c in ("low", "ended") else 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cols = np.stack([get("depth"), at, *(get(c) for c in ("n", "low", "kids", "leaves", "saved", "ended"))], axis=1)
        levels, spines = peel(path, size, offs, cols, last, spined)
        for x in levels:
            s, k = x["sums"], len(x["sums"].row)
            if k:
                yield pa.RecordBatch.from_arrays(
                    [ids(s.low), pa.array(np.full(k, x["depth"]), pa.int64()), ids(x["parent"]), *(pa.array(v, pa.int64()) for v in (s.n, s.kids, s.leaves, s.saved)), ids(s.ended),
                     pa.array(x["key"], pa.binary()), pa.array(x["parent_key"], pa.binary()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(entry))],
                    OUT_NAMES)
        for i, s in spines.items():
            blank = [pa.nulls(1, pa.binary() if c.endswith("key") else pa.int64()) for c in OUT_NAMES[:-3]]
            rows = pa.StructArray.from_arrays([pa.array(s[:, 0], pa.int32()), pa.array(s[:, 1], pa.int64()), ids(s[:, 2]), *(pa.array(s[:, j], pa.int64()) for j in (3, 4, 5)), ids(s[:, 6])],
                                              fields=list(entry))
            yield pa.RecordBatch.from_arrays([*blank, pa.array([path[i]], pa.binary()), pa.array([size[offs[i]:offs[i + 1]]], pa.list_(pa.int64())),
                                              pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), rows)], OUT_NAMES)
    return run


def collapse(found: DataFrame) -> DataFrame:
    """Equal conversations of ``paths`` as one row each: ``(path, sizes, entries)``."""
    one = found.groupBy(F.md5("path").alias("key")).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    zero = F.lit(0).cast("long")
    entry = F.struct(F.size("sizes").alias("depth"), F.col("n"), F.col("rep").alias("low"), zero.alias("kids"), zero.alias("leaves"), zero.alias("saved"), F.col("rep").alias("ended"))
    return one.select("path", "sizes", F.array(entry).cast(ENTRY).alias("entries"))


def prefix_trie(found: DataFrame, rows: int = ROWS, turns: int = TURNS, fan: int = FAN) -> DataFrame:
    """Nodes of the trie of ``paths (conv_id, path, sizes)``, with distinct ``conv_id``.

    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ended)``: ``conv_id`` is the smallest
    member, ``parent_conv_id`` the parent's (root: null), ``n_leaves`` and ``saved_tokens`` are sums over the subtree, and
    ``ended`` is the smallest conversation that ends at the node (none: null).
    """
    spark = found.sparkSession
    level = saved(collapse(found), "conversations")
    size = level.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("sizes")).alias("turns")).first()
    parts = max(1, -(-size["n"] // rows), -(-(size["turns"] or 0) // turns))
    nodes, spined = [], False
    while True:
        dealt = level.repartitionByRange(parts, "path") if parts > 1 else level.coalesce(1)
        out = saved(dealt.sortWithinPartitions("path").mapInArrow(_peel_rows(parts == 1, spined), f"{NODE}, {PATH}"), "trie")
        nodes.append(out.where("path is null").drop("path", "sizes", "entries"))
        if parts == 1:
            break
        level, spined = out.where("path is not null").select("path", "sizes", "entries"), True
        parts = -(-level.count() // max(4, fan))  # a partition leaves two spines at most, so there are fewer each time
    known = nodes[0]
    for more in nodes[1:]:
        known = known.unionByName(more)
    parent = known.where("node_key is not null").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("late"))
    parent = F.broadcast(parent) if parent.count() <= BROADCAST_ROWS else parent
    return known.join(parent, "parent_key", "left").select(
        "conv_id", "depth", F.coalesce("parent_conv_id", "late").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ended")


def ended_digests(found: DataFrame, block: int = 4096) -> DataFrame:
    """``(ended, digest)``: for each distinct path the smallest conversation, and the SHA-256 of all its ids, ascending, joined by commas.

    Ids are joined by blocks of ``block`` numbers where they are read; the blocks of a path are then hashed one after
    the other as they stream past, so a hot path needs no more memory than a rare one.
    """
    blocks = (found.groupBy(F.md5("path").alias("key"), F.floor(F.col("conv_id") / block).alias("block"))
              .agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
              .select("key", "block", F.array_min("ids").alias("least"), F.array_join("ids", ",").alias("ids")))

    def run(batches):
        key, least, sha = None, None, None
        for b in batches:
            out = []
            for k, low, ids in zip(*(b.column(c).to_pylist() for c in ("key", "least", "ids"))):
                if k != key:
                    if key is not None:
                        out.append((least, sha.hexdigest()))
                    key, least, sha = k, low, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digests(out)
        if key is not None:
            yield _digests([(least, sha.hexdigest())])

    return blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "ended long, digest string")


def _digests(rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["ended", "digest"])
