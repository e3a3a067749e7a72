"""Language model scores by context-tree weighting over bytes (operator 7).

Model. A byte is eight binary choices (a tree of 255 nodes); a choice is seen in the
contexts of the last 0 to ``DEPTH`` = 5 bytes. Each (context, node) has a Krichevsky-Trofimov
estimate from its counts. Bottom-up, its weighted probability is half its own estimate
plus half the product of its children's (the contexts one byte longer); the share of
the first half is the posterior weight of stopping there, and the probability of a
choice mixes the estimates of all depths by these weights. Texts are lower-cased A-Z,
begin in a context of FF bytes and end in the byte FF (which no UTF-8 text holds), so
the model is a distribution over texts; ``-score * log2(10) / bytes`` is the code length.

The tree is a Spark table that grows with the corpus. A gram is a byte with its five bytes of
context, nearest first, as one 48-bit number, so that sorting nests the contexts.

1. Texts are written in blocks of about ``BLOCK`` bytes. A task counts the grams of its
   blocks: every gram of every text, with its count in training texts (0 in held-out ones).
2. A partial aggregate sums the grams over all blocks. Partitioned by the three nearest bytes, a
   group has at most 2**24 grams whatever the corpus; groups are weighted in runs from depth 5
   to depth 3. The sums of what depth 3 hands to each (two bytes, node) are at most 2**24 rows; the
   driver weights depths 2 to 0 from them, and this table (of the same bound) is broadcast.
3. A second pass over the groups gives every gram its log probability. Blocks fetch
   those of their own grams by a join on the gram, and each block's texts meet them in one group.

Words are counted in the same pass over the texts. Their counts stay a table: the at most
2**18 most frequent words (all those with a count of some power of two or more) are
broadcast and settle most tokens where texts are scored; the rest go through a join by hash.

Defined results: null or empty text: one end, scored like any other byte. Nothing learned (also when the
table is empty): base score 0 for every token, and each bit costs one bit. A text of any length is
scored whole. Every input row gives one row, repeated rows too; a null id is never
held out and never trained on. Other columns are not read. Words are counted by 64-bit hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_profiles import held_out
from .shared import saved
from .words import _LOWER, SPACE, Tally, text_runs, word_hashes, word_spans

HEAD_WORDS = 1 << 18
END_WORD = -1  # the key of the end token
DEPTH = 5
BLOCK = 32 << 20  # bytes of text that fetch their grams together
RUN = 1 << 18  # grams that are weighted at a time, but for a larger group of one three-byte context


def byte_grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(gram at each byte and end, first gram of each text)``; the nearest context byte is the highest."""
    n, pad = len(offs) - 1, DEPTH + 1
    padded = np.full(len(data) + pad * n, 255, np.uint8)
    padded[np.arange(len(data)) + np.repeat(pad * np.arange(n) + DEPTH, np.diff(offs))] = _LOWER[data]
    grams = padded[DEPTH:].astype(np.int64)
    for d in range(1, DEPTH + 1):
        grams |= padded[DEPTH - d:len(padded) - d].astype(np.int64) << (8 * (pad - d))
    first = offs[:-1] + pad * np.arange(n)
    keep = np.ones(len(grams), bool)
    for gap in range(1, DEPTH + 1):  # grams that would run from one text into the next
        keep[first[1:] - gap] = False
    return grams[keep], offs[:-1] + np.arange(n)


def _in_blocks(batches):
    part, used = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        sizes = np.concatenate([np.diff(offs) for _, _, _, offs in text_runs(b.column(2))]) if b.num_rows else np.zeros(0, np.int64)
        before = used + np.cumsum(sizes) - sizes
        used += int(sizes.sum())
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part + before // BLOCK)], ["doc_id", "held_out", "text", "block"])


COUNTED = "kind int, block long, key long, n long"


def _count(batches):
    grams, words, block = Tally(), Tally(), None

    def rows(kind, tally):
        keys, counts = tally.merge()
        for a in range(0, len(keys), 100_000):
            k = keys[a:a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int32)), pa.array(np.full(len(k), block if kind == 0 else -1)),
                                              pa.array(k), pa.array(counts[a:a + 100_000])], ["kind", "block", "key", "n"])

    for b in batches:
        blocks, train = b.column(3).to_numpy(), b.column(1).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.concatenate(([True], (blocks[1:] != blocks[:-1]) | (train[1:] != train[:-1]), [True]))) if len(blocks) else []
        for x, y in zip(cuts[:-1], cuts[1:]):  # rows of one block that are alike in training
            if blocks[x] != block:
                yield from rows(0, grams)
                grams, block = Tally(), int(blocks[x])
            for i, j, data, offs in text_runs(b.column(2).slice(x, y - x)):
                keys, counts = np.unique(byte_grams(data, offs)[0], return_counts=True)
                grams.add(keys, counts if train[x] else np.zeros(len(keys), np.int64))
                if train[x]:
                    words.add(word_hashes(*word_spans(data, offs, SPACE)[:3]).astype(np.int64))
                    words.add(np.array([END_WORD]), np.array([j - i]))
    yield from rows(0, grams)
    yield from rows(1, words)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 0.5, by Stirling's series eight steps further up."""
    y, low = x + 8.0, np.zeros_like(x)
    p = np.ones_like(x)
    for i in range(8):
        p = p * (x + i)
        if i == 3:  # the product of eight large factors may overflow
            low, p = low + np.log(p), np.ones_like(x)
    r = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + r * (1 / 12 - r * r * (1 / 360 - r * r / 1260)) - low - np.log(p)


LOW = 1 << 14
_HALF, _WHOLE = log_gamma(np.arange(LOW) + 0.5), log_gamma(np.arange(LOW) + 1.0)


def kt(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ln block probability, probability that the next bit is 1)`` after a zeros and b ones."""
    low = np.minimum(a + b, LOW - 1).astype(np.int64)
    block = _HALF[np.minimum(a, LOW - 1).astype(np.int64)] + _HALF[np.minimum(b, LOW - 1).astype(np.int64)] - _WHOLE[low]
    big = np.flatnonzero(a + b >= LOW)
    if len(big):
        x, y = a[big].astype(float), b[big].astype(float)
        block[big] = log_gamma(x + 0.5) + log_gamma(y + 0.5) - log_gamma(x + y + 1)
    return block - np.log(np.pi), (b + 0.5) / (a + b + 1.0)


def weigh(own: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(ln weighted probability, share of stopping here)``."""
    both = np.logaddexp(own, below)
    return both - np.log(2), np.exp(own - both)


def shorter(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams without their farthest context byte, their counts, and the place of each given gram."""
    out, place = np.unique(grams >> 16 << 8 | grams & 255, return_inverse=True)
    return out, np.bincount(place, counts, len(out)).astype(np.int64), place


def level(grams: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one bit of the byte over sorted grams: ``(node of each gram, first gram, zeros, ones)``."""
    node = grams >> (8 - bit)
    new = np.concatenate(([True], node[1:] != node[:-1]))
    first = np.flatnonzero(new)
    ones = np.add.reduceat(np.where(grams >> (7 - bit) & 1, counts, 0), first)
    return np.cumsum(new) - 1, first, np.add.reduceat(counts, first) - ones, ones


def deep_levels(grams: np.ndarray, counts: np.ndarray):
    """Weights depths 5 to 3 over whole three-byte groups; for each bit ``(bit, depth-3 part, depth-5 part)``.

    The depth-3 part is ``(two bytes and node, zeros, ones, weighted)``; the depth-5 part is ``(node of each gram,
    first gram of each node, chance of a one at each node mixed over depths 3 to 5)``.
    """
    g4, c4, to4 = shorter(grams, counts)
    g3, c3, to3 = shorter(g4, c4)
    for bit in range(8):
        id5, at5, zero5, one5 = level(grams, counts, bit)
        id4, at4, zero4, one4 = level(g4, c4, bit)
        id3, at3, zero3, one3 = level(g3, c3, bit)
        up4, up3 = id4[to4[at5]], id3[to3[at4]]
        own5, p5 = kt(zero5, one5)
        own4, p4 = kt(zero4, one4)
        own3, p3 = kt(zero3, one3)
        w4, stop4 = weigh(own4, np.bincount(up4, own5, len(at4)))
        w3, stop3 = weigh(own3, np.bincount(up3, w4, len(at3)))
        p = stop4[up4] * p4[up4] + (1 - stop4[up4]) * p5
        up = up3[up4]
        yield bit, (upper_code(g3[at3] >> 16, g3[at3], bit), zero3, one3, w3), (id5, at5, stop3[up] * p3[up] + (1 - stop3[up]) * p)


def upper_code(two_bytes: np.ndarray, grams: np.ndarray, bit: int) -> np.ndarray:
    return two_bytes << 8 | 1 << bit | (grams & 255) >> (8 - bit)


def _groups(batches):
    """Sorted (gram, count) in runs that hold whole three-byte groups."""
    kept, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        kept.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        size += b.num_rows
        if size < RUN:
            continue
        grams, counts = (np.concatenate(x) for x in zip(*kept))
        cut = int(np.searchsorted(grams, grams[-1] >> 24 << 24))
        if cut:
            yield grams[:cut], counts[:cut]
        kept = [(grams[cut:], counts[cut:])]
        size = size - cut if cut else 0  # a group longer than a run is looked at again after another run
    if kept:
        grams, counts = (np.concatenate(x) for x in zip(*kept))
        if len(grams):
            yield grams, counts


def _upper(batches):
    for grams, counts in _groups(batches):
        for _, (code, zero, one, weight), _ in deep_levels(grams, counts):
            seen, place = np.unique(code, return_inverse=True)
            total = [np.bincount(place, x, len(seen)) for x in (zero, one, weight)]
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[0].astype(np.int64)), pa.array(total[1].astype(np.int64)), pa.array(total[2])], ["code", "zero", "one", "weight"])


def upper_table(code: np.ndarray, zero: np.ndarray, one: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, ...]:
    """Depths 0 to 2 from the sums that depth 3 hands up.

    ``(codes, base, rest, base1, rest1)``: the chance of a one is ``base + rest * (that of depths 3 to 5)``; the
    last two, by (last byte, node), are for codes that were never seen.
    """
    order = np.argsort(code)
    code, zero, one, below = code[order], zero[order], one[order], below[order]
    own2, p2 = kt(zero, one)
    w2, stop2 = weigh(own2, below)
    at1 = code >> 16 << 8 | code & 255
    zero1, one1, below1 = (np.bincount(at1, x, 1 << 16) for x in (zero, one, w2))
    own1, p1 = kt(zero1, one1)
    w1, stop1 = weigh(own1, below1)
    zero0, one0, below0 = (x.reshape(256, 256).sum(axis=0) for x in (zero1, one1, np.where(zero1 + one1 > 0, w1, 0.0)))
    own0, p0 = kt(zero0, one0)
    stop0 = weigh(own0, below0)[1]
    p0, stop0 = np.tile(p0, 256), np.tile(stop0, 256)
    base1, rest1 = stop0 * p0 + (1 - stop0) * stop1 * p1, (1 - stop0) * (1 - stop1)
    return code, base1[at1] + rest1[at1] * stop2 * p2, rest1[at1] * (1 - stop2), base1 + rest1 * 0.25, rest1 * 0.5


def gram_logs(grams: np.ndarray, counts: np.ndarray, upper: tuple[np.ndarray, ...]) -> np.ndarray:
    """log10 P(byte | its context) of sorted grams that make up whole three-byte groups."""
    codes, base, rest, base1, rest1 = upper
    logs = np.zeros(len(grams))
    for bit, _, (node, first, p) in deep_levels(grams, counts):
        code = upper_code(grams[first] >> 32, grams[first], bit)
        at1 = code >> 16 << 8 | code & 255
        one = base1[at1] + rest1[at1] * p
        if len(codes):
            at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            one = np.where(codes[at] == code, base[at] + rest[at] * p, one)
        logs += np.where(grams >> (7 - bit) & 1, np.log10(one)[node], np.log10(1 - one)[node])
    return logs


def _gram_logs(upper):
    def run(batches):
        for grams, counts in _groups(batches):
            logs = gram_logs(grams, counts, upper.value)
            for a in range(0, len(grams), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(grams[a:a + 100_000]), pa.array(logs[a:a + 100_000])], ["key", "log"])
    return run


class Places:
    """Finds the places of 64-bit keys, all of which are in the table: a few hash tables, each for what collides in the one before."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.tables, left = keys, [], np.arange(len(keys), dtype=np.int32)
        while len(left):
            shift = np.uint64(61 - max(1, len(left)).bit_length())
            factor = np.uint64(0x9E3779B97F4A7C15 + 0x632BE59BD9B4E018 * len(self.tables) & 0xFFFFFFFFFFFFFFFF)
            table = np.zeros(1 << (64 - int(shift)), np.int32)
            slot = keys[left].astype(np.uint64) * factor >> shift
            table[slot] = left
            self.tables.append((factor, shift, table))
            left = left[table[slot] != left]

    def of(self, wanted: np.ndarray) -> np.ndarray:
        out, left = np.zeros(len(wanted), np.int32), None
        for factor, shift, table in self.tables:
            now = wanted if left is None else wanted[left]
            at = table[now.astype(np.uint64) * factor >> shift]
            miss = np.flatnonzero(self.keys[at] != now)
            if left is None:
                out, left = at, miss
            else:
                out[left] = at
                left = left[miss]
        if left is not None and len(left):
            raise ValueError("a gram of a text is not among those of its block")
        return out


TAIL = pa.list_(pa.struct([("key", pa.int64()), ("n", pa.int64())]))


def _score(head):
    def run(texts, fetched):
        words, word_logs = head.value
        grams, at = np.unique(fetched.column("key").to_numpy(), return_index=True)
        logs, places = fetched.column("log").to_numpy()[at], Places(grams)
        out = []
        for b in texts.combine_chunks().to_batches():
            for i, j, data, offs in text_runs(b.column(2)):
                codes, start = byte_grams(data, offs)
                score = np.add.reduceat(logs[places.of(codes)], start)
                low, st, en, first = word_spans(data, offs, SPACE)
                h = word_hashes(low, st, en).astype(np.int64)
                at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
                known = words[at] == h if len(words) else np.zeros(len(h), bool)
                gain = np.concatenate(([0.0], np.cumsum(np.where(known, word_logs[at], 0.0) if len(words) else np.zeros(len(h)))))
                seen = np.concatenate(([0], np.cumsum(known)))
                tails = []
                for x, y in zip(first[:-1].tolist(), first[1:].tolist()):
                    k, n = np.unique(h[x:y][~known[x:y]], return_counts=True)
                    tails.append((k, n))
                sizes = [len(k) for k, _ in tails]
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate([k for k, _ in tails])), pa.array(np.concatenate([n for _, n in tails]).astype(np.int64))], fields=list(TAIL.value_type))
                out.append(pa.RecordBatch.from_arrays(
                    [*[c.slice(i, j - i) for c in b.columns[:2]], pa.array(np.diff(offs)), pa.array(np.diff(first) + 1),
                     pa.array(seen[first[1:]] - seen[first[:-1]]), pa.array(gain[first[1:]] - gain[first[:-1]]), pa.array(score),
                     pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)],
                    ["doc_id", "held_out", "n_bytes", "n_tokens", "known", "gain", "score", "tail"]))
        return pa.Table.from_batches(out)
    return run


def score_texts(docs: DataFrame, mod: int = 7, rest: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score)`` for every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(f"`{id_col}`", mod, rest).alias("held_out"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = saved(docs.mapInArrow(_in_blocks, f"doc_id {kind}, held_out boolean, text string, block long"), "blocks")
    learned = saved(docs.select("doc_id", (~F.col("held_out") & F.col("doc_id").isNotNull()).alias("train"), "text", "block").mapInArrow(_count, COUNTED), "counts")
    words = saved(learned.where("kind = 1").groupBy("key").agg(F.sum("n").alias("n")), "words")
    grams = saved(learned.where("kind = 0").groupBy("key").agg(F.sum("n").alias("n")), "grams")
    groups = grams.repartition(F.shiftright("key", 24)).sortWithinPartitions("key")
    share = spark.sparkContext.broadcast
    upper = (groups.where("n > 0").mapInArrow(_upper, "code long, zero long, one long, weight double")
             .groupBy("code").agg(*[F.sum(c).alias(c) for c in ("zero", "one", "weight")]).toArrow())  # at most 2**24 rows
    upper = share(upper_table(*[upper.column(c).to_numpy() for c in ("code", "zero", "one", "weight")]))
    logs = groups.mapInArrow(_gram_logs(upper), "key long, log double")
    fetched = learned.where("kind = 0").select("block", "key").join(logs, "key").select("block", "key", "log")
    by_size = sorted((r["p"], r["words"], r["n"]) for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("p"))
                     .agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("n")).collect())  # at most 63 rows
    total, kinds = sum(n for _, _, n in by_size), sum(w for _, w, _ in by_size)
    least, room = 63, HEAD_WORDS
    for p, w, _ in reversed(by_size):
        if w > room:
            break
        least, room = p, room - w
    head = words.where((F.floor(F.log2("n")) >= least) | (F.col("key") == END_WORD)).toArrow()  # at most HEAD_WORDS + 1 rows
    keys, counts = head.column(0).to_numpy(), head.column(1).to_numpy()
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    end = float(np.log10(counts[keys == END_WORD][0] + 1)) if END_WORD in keys else 0.0
    rows = docs.groupBy("block").cogroup(fetched.groupBy("block")).applyInArrow(
        _score(share((keys, np.log10(counts + 1.0)))), f"doc_id {kind}, held_out boolean, n_bytes long, n_tokens long, known long, gain double, score double, tail array<struct<key:long,n:long>>")
    rows = saved(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = words.where(F.floor(F.log2("n")) < least).withColumnRenamed("n", "c")
    more = (rows.select("row", F.explode("tail").alias("t")).select("row", "t.*").join(rare, "key")
            .groupBy("row").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more")))
    per_token = float(np.log10(total + kinds + 1))
    return rows.drop("tail").join(more, "row", "left").select(
        "doc_id", "held_out", "n_bytes", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0)) + (1 if kinds else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("gain") + F.coalesce("more", F.lit(0.0)) + end - F.col("n_tokens") * per_token).alias("base_score"), "score")
