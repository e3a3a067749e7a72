"""N-gram Jaccard join by PartEnum signatures (operator 2).

``jaccard_classes`` finds all links between documents whose sets of distinct
``k``-word shingles have Jaccard similarity >= ``num / den`` and returns one row
per document with its class.

Method. Equal sets form one class (a partial aggregate, so a hot group of copies
collapses before the shuffle). Sizes fall into bands of ratio den/num; sets of one
band or of neighbouring bands can be similar, and then differ in at most
``limit`` elements. PartEnum cuts the feature domain by hash into ``n1`` parts, and
each into ``n2`` smaller ones: some part holds at most ``k2`` differences, so one of
its subsets of ``n2 - k2`` small parts is equal in both sets. Every set emits the
hash of its projection on each such subset for the two groups of bands it belongs
to; similar sets share a signature. A projection without elements is left out when
the set has few enough of them for the argument to hold without it, otherwise it is
emitted as well, so no link is lost.

Signatures that two sets or more share are kept as buckets (a bucket of up to four sets as its
pairs, once each). In a bucket two sets are compared by parity sketches: a bit per cell of a hash
of the elements, about as many cells as elements; sets that differ in d elements differ in at most d
cells, so a pair with more differing cells than similar sets may have is out, exactly. The
pairs left link sets into groups, of which each bucket returns a spanning forest, not its pairs.
Each group is then checked exactly, whole sets against whole sets. Buckets and groups are worked
on in blocks of bounded size: a large one becomes block pairs that run in separate tasks, and
each task returns a spanning forest and link counts.

Defined results: null or wordless text: empty set, size 0, own class, no links. Fewer than
``k`` words: the whole run is one shingle. Very long texts: whole sets, a set is one row. Repeated rows are copies,
each with its own row of the result; so are several texts under one id, each linked by its own text, and rows with a
null id (a class of such rows alone has a null component). Extra columns are ignored, whatever their names. An empty
table gives an empty result.
Sets are compared by 64-bit shingle hashes, classes of equal sets by 128 bits and size.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bit_filter, components, free, in_filter, saved, with_row_number
from .words import SPACE, U, mix, shingle_sets, text_runs, word_hashes, word_spans

BLOCK_DOCS = 512  # sets of one side of a block pair
BUCKET_BLOCK = 1_024  # sketches of one side of a block pair of a bucket
BUCKET_CELLS = 1 << 27  # expected cells of those sketches: 16 MiB, for sets of any size
PAIRS_UP_TO = 4  # buckets of so many sets are kept as pairs
BLOCK_ITEMS = 1_000_000  # expected shingles of one side of a block pair
TASK_ITEMS = 250_000  # expected shingles of the groups that share a task


def band_starts(n: int, num: int, den: int) -> list[int]:
    """Band starts 1 = l0 < l1 < ... up to the first one beyond ``n`` and two more.

    ``l(j+1) >= l(j) * den / num``: a set of band j is never similar to one of band j + 2 or more.
    """
    out = [1]
    while len(out) < 3 or out[-3] <= n:
        lo = out[-1]
        out.append(max(lo + 1, -(-lo * den // num)))
    return out


def plan(starts: list[int], j: int, num: int, den: int) -> tuple[int, int, int, int]:
    """``(limit, k2, n1, n2)`` of the group of bands j and j + 1.

    ``limit``: the most elements in which two similar sets of the group differ,
    ``floor((den - num) * (r + s) / (den + num))`` for the largest r of band j and s <= r * den / num.
    Small sets get more enumeration (larger projections, hence fewer chance matches).
    """
    r = starts[j + 1] - 1
    s = min(starts[j + 2] - 1, r * den // num)
    limit = (den - num) * (r + s) // (den + num)
    if limit == 0:
        return 0, 0, 1, 1
    dense = num * 20 >= den * 17  # from 0.85 on, plain parts hold enough elements
    k2, n2 = (0, 1) if dense or s > 150 else (1, 4)
    need = limit // (k2 + 1)
    return limit, k2, need + 1 + (need // 20 if need >= 20 else 0), n2


_SUBSETS: dict[tuple[int, int], np.ndarray] = {}


def subsets(n2: int, k2: int) -> np.ndarray:
    """0/1 matrix: which of ``n2`` small parts belong to each subset of ``n2 - k2``."""
    if (n2, k2) not in _SUBSETS:
        cols = list(itertools.combinations(range(n2), n2 - k2))
        m = np.zeros((n2, len(cols)), dtype=U)
        for c, parts in enumerate(cols):
            m[list(parts), c] = 1
        _SUBSETS[n2, k2] = m
    return _SUBSETS[n2, k2]


def signatures(items: np.ndarray, starts: list[int], num: int, den: int) -> np.ndarray:
    """All PartEnum signatures of a set of 64-bit elements."""
    n = len(items)
    band = int(np.searchsorted(starts, n, "right")) - 1
    place, value = mix(items, 7), mix(items, 9)
    out = []
    for j in ((band - 1, band) if band else (band,)):
        limit, k2, n1, n2 = plan(starts, j, num, den)
        cell = ((place >> U(32)) % U(n1)).astype(np.int64) * n2 + ((place & U(0xFFFFFFFF)) % U(n2)).astype(np.int64)
        order = np.argsort(cell)
        cell = cell[order]
        cut = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sums, count = np.zeros(n1 * n2, U), np.zeros(n1 * n2, U)
        sums[cell[cut]] = np.add.reduceat(value[order], cut)
        count[cell[cut]] = np.diff(np.append(cut, n)).astype(U)
        m = subsets(n2, k2)
        sums, count = sums.reshape(n1, n2), count.reshape(n1, n2)
        if n2 > 1:
            sums, count = sums @ m, count @ m
        sig = mix(sums + np.arange(sums.size, dtype=U).reshape(sums.shape) * U(0x9E3779B97F4A7C15) + U(j * 0x51ED270B + 1), 3)
        # parts with more than k2 differences: at most limit // (k2 + 1); one more full part than that is left
        weak = int((count == 0).any(axis=1).sum())
        out.append(sig[count > 0] if weak <= n1 - limit // (k2 + 1) - 1 else sig.ravel())
    return np.unique(np.concatenate(out))


def batch_sets(texts: pa.Array, k: int):
    """``(row, set)`` of each text of an Arrow column."""
    for i, _, data, offs in text_runs(texts):
        low, st, en, first = word_spans(data, offs, SPACE)
        for r, s in enumerate(shingle_sets(word_hashes(low, st, en), first, k)):
            yield i + r, s


def set_prints(items: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set, as signed integers."""
    a, b = mix(items, 21).sum(dtype=U), mix(items, 22).sum(dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sizes(k: int):
    def run(batches):
        for b in batches:
            n, f1, f2 = [], [], []
            for _, s in batch_sets(b.column(1), k):
                x, y = set_prints(s)
                n.append(len(s)), f1.append(x), f2.append(y)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64())], ["doc_id", "n", "f1", "f2"])
    return run


def sketch(items: np.ndarray) -> np.ndarray:
    """Parities of the set in cells of a hash, packed in 64-bit words; a power of two of cells, at least 64."""
    cells = max(64, 1 << (len(items) - 1).bit_length())
    odd = np.bincount((mix(items, 31) & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A sketch brought down to ``size`` words: halves of cells meet in the parity of their sum."""
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def _fresh_sets(k: int, column: int):
    """``(row, set, print)`` of the batches' sets, empty ones and those already seen in this task left out."""
    seen: set[int] = set()  # as many numbers as the split has different documents

    def of(batch):
        for r, s in batch_sets(batch.column(column), k):
            f1 = set_prints(s)[0]
            if len(s) and f1 not in seen:
                seen.add(f1)
                yield r, s, f1
    return of


def _signature_rows(k: int, num: int, den: int):
    """Rows ``(sig, node)``, the rows of a set together."""
    def run(batches):
        fresh, starts = _fresh_sets(k, 0), band_starts(1, num, den)
        for b in batches:
            sigs, nodes, size = [], [], 0
            for _, s, f1 in fresh(b):
                if starts[-3] <= len(s):
                    starts = band_starts(2 * len(s), num, den)
                g = signatures(s, starts, num, den)
                sigs.append(g)
                nodes.append(np.full(len(g), f1, np.int64))
                size += len(g)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.concatenate(nodes))], ["sig", "node"])
                    sigs, nodes, size = [], [], 0
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).astype(np.int64)), pa.array(np.concatenate(nodes))], ["sig", "node"])
    return run


def _buckets(batches):
    """Rows ``(bucket, node)`` of signatures shared by two sets or more, from sorted rows.

    A run of up to ``PAIRS_UP_TO`` sets inside a batch gives its pairs, each as a bucket of its own;
    a run that goes over batches keeps its signature as bucket.
    """
    sig, node = np.zeros(0, np.int64), np.zeros(0, np.int64)  # the last run so far, at most one row once it was kept
    kept = False
    for b in batches:
        sig, node = np.concatenate((sig, b.column(0).to_numpy())), np.concatenate((node, b.column(1).to_numpy()))
        cut = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(cut, len(sig)))
        open_run = np.zeros(len(cut), bool)
        open_run[-1] = True  # may go on in the next batch
        carried = np.zeros(len(cut), bool)
        carried[0] = kept
        big = (size > PAIRS_UP_TO) | (carried & (size > 1)) | (open_run & (size > 1))
        whole = np.repeat(big, size)
        if kept:
            whole[0] = False  # that row is out already
        out_b, out_n = [sig[whole]], [node[whole]]
        for m in range(2, PAIRS_UP_TO + 1):
            at = cut[(size == m) & ~big]
            for i, j in itertools.combinations(range(m), 2):
                x, y = np.minimum(node[at + i], node[at + j]), np.maximum(node[at + i], node[at + j])
                pair = (mix(mix(x.astype(U), 41) + y.astype(U), 42)).astype(np.int64)
                out_b += [pair, pair]
                out_n += [x, y]
        rows = np.unique(np.stack([np.concatenate(out_b), np.concatenate(out_n)]), axis=1)
        if rows.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1])], ["bucket", "node"])
        kept = bool(big[-1]) or (kept and len(cut) == 1)
        last = cut[-1]
        sig, node = sig[last:last + 1], node[last:last + 1]


def _sketches(k: int, bits):
    """``(node, n, sketch)`` of the sets whose print passes the bitmap, once a task."""
    def run(batches):
        fresh = _fresh_sets(k, 0)
        for b in batches:
            rows = [(f1, len(s), sketch(s).tobytes()) for _, s, f1 in fresh(b) if in_filter(bits.value, np.array([f1], np.int64))[0]]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["node", "n", "sketch"])
    return run


def possible_links(n: np.ndarray, words: list[np.ndarray], block: np.ndarray, cross: bool, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs that sizes and sketches do not rule out; ``cross``: only pairs of different blocks."""
    size = min(len(w) for w in words)
    table = np.stack([folded(w, size) for w in words])
    root, out = list(range(len(n))), []

    def find(v):
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i in range(len(n) - 1):
        r, s = np.minimum(n[i], n[i + 1:]), np.maximum(n[i], n[i + 1:])
        ok = (s * num <= r * den) & (np.bitwise_count(table[i + 1:] ^ table[i]).sum(axis=1, dtype=np.int64) * (den + num) <= (den - num) * (r + s))
        if cross:
            ok &= block[i + 1:] != block[i]
        for j in (i + 1 + np.flatnonzero(ok)).tolist():
            p, q = find(i), find(j)
            if p != q:
                root[p] = q
                out.append((i, j))
    return out


def _bucket_links(num: int, den: int):
    """Edges ``(a, b)`` from rows sorted by ``key``: the rows of a key are one bucket or one block pair of a bucket."""
    def edges(parts):
        node, n, block, pair = (np.concatenate([p[i] for p in parts]) for i in range(4))
        words = [np.frombuffer(x, dtype=U) for p in parts for x in p[4]]
        links = possible_links(n, words, block, bool(pair[0] >= 0), num, den) if len(n) > 1 else []
        return [(min(int(node[i]), int(node[j])), max(int(node[i]), int(node[j]))) for i, j in links]

    def run(batches):
        last, waiting = None, []
        for b in batches:
            key = b.column(0).to_numpy()
            cols = [b.column(i).to_numpy() for i in range(1, 5)]
            blobs = b.column(5).to_pylist()
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist() + [len(key)]
            out = []
            for x, y in zip(cut[:-1], cut[1:]):
                if waiting and key[x] != last:
                    out += edges(waiting)
                    waiting = []
                waiting.append([*[c[x:y] for c in cols], blobs[x:y]])
                last = key[x]
            if out:
                found = np.unique(np.array(out, np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])
        if waiting and (out := edges(waiting)):
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])
    return run


def block_pairs(members: DataFrame, group: str, member: str, blocks: DataFrame) -> DataFrame:
    """``members`` placed in the pairs of blocks of their group: ``block``, ``pair`` (-1: inside one block) and ``key``.

    ``blocks (group, blocks)``: how many blocks each group has. Members fall into blocks by hash; those of
    a group of one block stay single rows, the others are copied once for every block.
    """
    placed = members.join(blocks, group).withColumn("block", F.pmod(F.xxhash64(member), F.col("blocks")))
    single = F.col("blocks") == 1
    other = F.explode(F.when(single, F.array(F.col("block"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.withColumn("other", other)
    key = F.xxhash64(group, F.least("block", "other"), F.greatest("block", "other"))
    return placed.withColumn("key", key).withColumn("pair", F.when(F.col("block") == F.col("other"), F.lit(-1).cast("long")).otherwise(F.col("other"))).drop("other")


def _candidate_edges(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Edges ``(a, b)`` between set prints; every link lies inside a connected group of them."""
    spark = docs.sparkSession
    text = docs.select("text")
    sig = text.mapInArrow(_signature_rows(k, num, den), "sig long, node long")
    bucket = saved(sig.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_buckets, "bucket long, node long").distinct(), "buckets")
    bits = spark.sparkContext.broadcast(bit_filter(bucket, "node"))
    sketches = saved(text.mapInArrow(_sketches(k, bits), "node long, n long, sketch binary").dropDuplicates(["node"]), "sketches")
    blocks = bucket.join(sketches.select("node", "n"), "node").groupBy("bucket").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / BUCKET_BLOCK, F.sum("n") / BUCKET_CELLS)).alias("blocks"))
    placed = block_pairs(bucket, "bucket", "node", blocks).join(sketches, "node")
    rows = placed.select("key", "node", "n", "block", "pair", "sketch").repartition("key").sortWithinPartitions("key")
    return saved(rows.mapInArrow(_bucket_links(num, den), "a long, b long").distinct(), "candidates")


def _chosen_sets(k: int, bits):
    """Whole sets of the documents that pass the bitmap."""
    def run(batches):
        for b in batches:
            hit = np.flatnonzero(in_filter(bits.value, b.column(0).to_numpy()))
            if not len(hit):
                continue
            b = b.take(pa.array(hit))
            ids, blobs, size = [], [], 0
            for r, s in batch_sets(b.column(1), k):
                ids.append(b.column(0)[r].as_py())
                blobs.append(s.tobytes())
                size += s.nbytes
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "items"])
                    ids, blobs, size = [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "items"])
    return run


def exact_links(sets: list[np.ndarray], side: np.ndarray, cross: bool, num: int, den: int):
    """``(i, j)`` index arrays, one row ``i`` at a time, of all pairs with Jaccard >= num / den.

    ``cross``: only pairs whose sides differ.
    """
    n = np.array([len(s) for s in sets])
    order = np.argsort(n, kind="stable")
    n, side = n[order], side[order]
    top = np.searchsorted(n, n * den // num, "right")
    if len(sets) <= 8:
        for i in range(len(sets)):
            a = sets[order[i]]
            hits = []
            for j in range(i + 1, int(top[i])):
                if cross and side[i] == side[j]:
                    continue
                z = np.concatenate((a, sets[order[j]]))
                z.sort()
                both = int((z[1:] == z[:-1]).sum())
                if den * both >= num * (n[i] + n[j] - both):
                    hits.append(j)
            if hits:
                yield order[i], order[hits]
        return
    items = np.concatenate([sets[o] for o in order])
    owner = np.repeat(np.arange(len(order)), n)
    by = np.argsort(items, kind="stable")
    first = np.concatenate(([True], items[by][1:] != items[by][:-1]))
    ident = np.cumsum(first) - 1
    df = np.bincount(ident)
    new = np.cumsum(df > 1) - 1  # elements of one set alone join nothing
    many = df[ident] > 1
    col, row = new[ident][many], owner[by][many]
    table = np.zeros((len(order), (int(new[-1]) + 64) // 64), dtype=U)
    np.bitwise_or.at(table, (row, col >> 6), U(1) << (col & 63).astype(U))
    for i in range(len(order)):
        z = int(top[i])
        if z <= i + 1:
            continue
        words = np.flatnonzero(table[i])  # only the columns in which row i has bits
        both = np.bitwise_count(table[i + 1:z, words] & table[i, words]).sum(axis=1, dtype=np.int64)
        ok = den * both >= num * (n[i] + n[i + 1:z] - both)
        if cross:
            ok &= side[i + 1:z] != side[i]
        if ok.any():
            yield order[i], order[i + 1 + np.flatnonzero(ok)]


def _check_group(num: int, den: int):
    """Spanning forest and link counts of the groups of a task key: rows ``(a, b, links)``."""
    def run(table: pa.Table) -> pa.Table:
        ids, group, block = (table.column(c).to_numpy() for c in ("doc_id", "cluster", "block"))
        cross_of = table.column("pair").to_numpy()  # -1: all pairs of the group, else its other block
        weight, blobs = table.column("copies").to_numpy(), table.column("items").combine_chunks()
        order = np.argsort(group, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], group[order][1:] != group[order][:-1]))).tolist() + [len(order)]
        out_a, out_b, out_n = [], [], []
        for x, y in zip(cut[:-1], cut[1:]):
            rows = order[x:y]
            if y - x < 2:
                continue
            # the id of a repeated row brings its set more than once
            _, once = np.unique([f"{ids[r]} {len(blobs[int(r)].as_buffer())} {weight[r]}" for r in rows], return_index=True)
            rows = rows[np.sort(once)]
            sets = [np.frombuffer(blobs[int(r)].as_buffer(), dtype=U) for r in rows]
            root = list(range(len(rows)))

            def find(v, root=root):
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            links = np.zeros(len(rows), np.int64)
            for i, js in exact_links(sets, block[rows], bool(cross_of[rows[0]] >= 0), num, den):
                links[i] += weight[rows[js]].sum()
                links[js] += weight[rows[i]]
                for j in js.tolist():
                    p, q = find(int(i)), find(j)
                    if p != q:
                        root[p] = q
                        out_a.append(int(ids[rows[i]])), out_b.append(int(ids[rows[j]])), out_n.append(0)
            for v in np.flatnonzero(links):
                out_a.append(int(ids[rows[v]])), out_b.append(int(ids[rows[v]])), out_n.append(int(links[v]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "links": pa.array(out_n, pa.int64())})
    return run


def jaccard_classes(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, n_links)`` for links of Jaccard >= num / den, one row a row; see the module text.

    ``component_id``: the smallest id reachable by links, itself included (nulls last); ``n_links``: how many other rows
    are linked directly. Where ids repeat or are null the rows are numbered first, so that each is judged by its own text.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    ids = docs.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("d")).first()
    if ids["n"] == ids["d"]:
        return _classes(docs, k, num, den)
    docs = with_row_number(docs, "row", "numbered")
    found = _classes(docs.select(F.col("row").alias("doc_id"), "text"), k, num, den).withColumnRenamed("doc_id", "row")
    found = saved(found.join(docs.select("row", "doc_id"), "row"), "numbered-classes")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"), "n_links")


def _classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``jaccard_classes`` of rows ``(doc_id, text)`` whose ids are distinct."""
    spark = docs.sparkSession
    sizes = saved(docs.mapInArrow(_sizes(k), "doc_id long, n long, f1 long, f2 long"), "set-sizes")
    classes = saved(sizes.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "set-classes")

    groups = components(_candidate_edges(docs, k, num, den))

    member = classes.join(groups, classes["f1"] == groups["node"]).select(F.col("rep").alias("doc_id"), "n", "copies", F.col("root").alias("cluster"))
    member = saved(member, "members")
    blocks = member.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_DOCS, F.sum("n") / BLOCK_ITEMS)).alias("blocks"))
    placed = block_pairs(member, "cluster", "doc_id", blocks)
    # groups of one block share tasks; of the others each block pair is a task of its own
    tasks = max(1, int((member.agg(F.sum("n")).first()[0] or 0) // TASK_ITEMS))
    placed = placed.withColumn("task", F.when(F.col("blocks") == 1, F.pmod("key", F.lit(tasks))).otherwise(F.col("key")))
    bits = spark.sparkContext.broadcast(bit_filter(member.withColumn("k", F.col("doc_id")), "k"))
    sets = docs.mapInArrow(_chosen_sets(k, bits), "doc_id long, items binary")
    checked = saved(sets.join(placed.select("doc_id", F.col("key").alias("cluster"), "block", "pair", "copies", "task"), "doc_id")
                    .groupBy("task").applyInArrow(_check_group(num, den), "a long, b long, links long"), "links")
    roots = components(checked.where("a <> b").select("a", "b"))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    roots = roots.join(least, "root").select(F.col("node").alias("rep"), "component")
    counts = checked.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = classes.join(roots, "rep", "left").join(counts, "rep", "left")
    found = classes.select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return sizes.join(found, ["n", "f1", "f2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_first(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class of near duplicates, decided row by row.

    The row with the smallest id stays (nulls last, then by a written row number): repeated rows of one
    id, rows with a null id and different texts under one id are rows like all others.
    """
    row, first, gone_row = free(docs, "_row", "_first", "_gone")
    docs_ = with_row_number(docs, row, "numbered")
    found = _classes(docs_.select(F.col(row).alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")), k, num, den).where("n_links > 0").select(F.col("doc_id").alias(row), "component_id")
    key = F.struct(F.col(f"`{id_col}`").isNull().alias("a"), F.col(f"`{id_col}`").alias("b"), F.col(row).alias("c"))
    member = saved(docs_.select(row, key.alias("o")).join(found, row), "linked")
    least = saved(member.groupBy("component_id").agg(F.min("o").alias(first)), "first")
    gone = saved(member.join(least, "component_id").where(F.col("o.c") != F.col(f"{first}.c")).select(F.col(row).alias(gone_row)), "gone")
    return docs_.join(gone, F.col(row) == F.col(gone_row), "left_anti").drop(row)
