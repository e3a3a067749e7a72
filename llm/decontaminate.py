"""Benchmark decontamination by winnowing (operator 10).

``contamination`` finds every occurrence of an item window (``window`` consecutive
words of a benchmark item; a shorter item is one window) in the documents.

Method. Both sides keep the smallest ``k``-gram hash of each run of
``window - k + 1`` consecutive k-grams (the rightmost of equal ones). A shared span
of ``window`` words holds one such run, so both sides keep the same k-gram of it:
every occurrence carries a shared fingerprint. Document fingerprints are tested
against a fixed-size bitmap of the benchmark's; around each hit the windows that
cover it are taken (the extension), tested against a bitmap of the item windows, and
the few that remain are joined to the item windows by hash and compared word by
word, so the result is exact. Windows of short items are looked up at every word.

Nothing but the two bitmaps (512 KiB each, whatever the benchmark's size) is
broadcast; documents are never shuffled, only their hits are.

Defined results: null or wordless text: no words, no hits. Each input row gives one
row, also when ids repeat or are null. Equal items all count. An empty benchmark hits
nothing. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bit_filter, free, in_filter, saved, with_row_number
from .words import ALNUM, gram_hashes, grams_at, text_runs, word_hashes, word_spans

WINDOW = 10
K = 5


def winnow(grams: np.ndarray, first: np.ndarray, k: int, window: int) -> np.ndarray:
    """Positions of the kept k-grams of every text; ``first``: first word of each text plus the total.

    Only runs inside one text count; a text of fewer than ``window`` words keeps none.
    """
    run = window - k + 1
    if len(grams) < run:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, run)
    at = np.arange(len(view)) + run - 1 - np.argmin(view[:, ::-1], axis=1)
    end = np.repeat(first[1:], np.diff(first))[:len(view)]
    return np.unique(at[np.arange(len(view)) + window <= end])


def _spell(low: np.ndarray, st: np.ndarray, en: np.ndarray, at: int, size: int) -> str:
    return b" ".join(low[a:b].tobytes() for a, b in zip(st[at:at + size].tolist(), en[at:at + size].tolist())).decode("utf-8", "replace")


def _item_rows(window: int, k: int):
    """Rows ``(item_id, size, h, words)``: windows, and with null words the kept k-grams."""
    def run(batches):
        for b in batches:
            ids = b.column(0)
            for i, _, data, offs in text_runs(b.column(1)):
                low, st, en, first = word_spans(data, offs, ALNUM)
                h = word_hashes(low, st, en)
                kept = winnow(gram_hashes(h, k), first, k, window)
                out = [(None, k, int(x), None) for x in np.unique(grams_at(h, kept, k)).astype(np.int64)]
                for r, (a, z) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
                    size = min(window, z - a)
                    if not size:
                        continue
                    at = np.arange(a, z - size + 1)
                    hs = grams_at(h, at, size).astype(np.int64)
                    out += [(ids[i + r].as_py(), size, int(x), _spell(low, st, en, p, size)) for p, x in zip(at.tolist(), hs)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.string()))],
                                                     ["item_id", "size", "h", "words"])
    return run


SPOT = pa.struct([("at", pa.int64()), ("size", pa.int64()), ("h", pa.int64()), ("words", pa.string())])


def _doc_rows(window: int, k: int, prints, windows, short: list[int]):
    def spots(low, st, en, h, first):
        """``(position, size, hash)`` of the document windows that may be item windows."""
        total = len(h)
        begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
        found = []
        kept = winnow(gram_hashes(h, k), first, k, window)
        kept = kept[in_filter(prints.value, grams_at(h, kept, k))]
        if len(kept):
            at = (kept[:, None] - np.arange(window - k + 1)[None, :])
            ok = (at >= begin[kept][:, None]) & (at + window <= end[kept][:, None])
            found.append((window, np.unique(at[ok])))
        for size in short:
            p = np.arange(max(0, total - size + 1))
            found.append((size, p[p + size <= end[:len(p)]]))
        for size, at in found:
            hs = grams_at(h, at, size)
            good = in_filter(windows.value, hs)
            for p, x in zip(at[good].tolist(), hs[good].astype(np.int64).tolist()):
                yield p, size, x

    def run(batches):
        for b in batches:
            for i, j, data, offs in text_runs(b.column(1)):
                low, st, en, first = word_spans(data, offs, ALNUM)
                h = word_hashes(low, st, en)
                per: list[list] = [[] for _ in range(j - i)]
                for p, size, x in spots(low, st, en, h, first):
                    r = int(np.searchsorted(first, p, "right")) - 1
                    per[r].append({"at": p - int(first[r]), "size": size, "h": x, "words": _spell(low, st, en, p, size)})
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(np.diff(first), pa.int64()), pa.array(per, pa.list_(SPOT))],
                                                 ["doc_id", "n_words", "spots"])
    return run


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids)``: words inside item windows, and the ids (as sorted strings) of the items found."""
    spark = docs.sparkSession
    items = saved(benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
                  .mapInArrow(_item_rows(window, k), "item_id string, size long, h long, words string").distinct(), "item-windows")
    prints = items.where("words is null")
    items = items.where("words is not null")
    short = sorted(r["size"] for r in items.where(F.col("size") < window).select("size").distinct().collect())  # at most window - 1 values
    share = spark.sparkContext.broadcast
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        _doc_rows(window, k, share(bit_filter(prints, "h")), share(bit_filter(items, "h")), short),
        f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, spots array<struct<at:long,size:long,h:long,words:string>>")
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), "spots")
    hit = (found.where(F.size("spots") > 0).select("row", F.explode("spots").alias("s")).select("row", "s.*")
           .join(items.select("item_id", "h", "words"), ["h", "words"]))
    spans = F.array_sort(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(spans, zero, lambda z, s: F.struct(
        F.greatest(z["end"], s["end"]).alias("end"),
        (z["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(z["end"], s["at"]))).alias("n")))["n"]
    hit = hit.groupBy("row").agg(covered.alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return found.select("row", "doc_id", "n_words").join(hit, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that hold an item window; the others stay whole, also those of the same id."""
    row, bad_row = free(docs, "_row", "_bad")
    docs = with_row_number(docs, row, "numbered")
    bad = contamination(docs, benchmark, window, k, row).where("n_hit > 0").select(F.col("doc_id").alias(bad_row))
    return docs.join(saved(bad, "contaminated"), F.col(row) == F.col(bad_row), "left_anti").drop(row)
