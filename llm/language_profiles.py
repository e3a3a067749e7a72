"""Language identification by rank-order profiles (operator 9).

A profile is the list of the ``size`` most frequent letter n-grams (one to three
code points, words padded with a blank) of a language, ranked by count, ties by
code. A document's own list is made of its whole text; its out-of-place distance
to a profile sums, over its n-grams, how far the two ranks lie apart, and ``size``
for an n-gram that the profile lacks. The nearest profile wins (ties: the first
language in alphabetical order); the score is one less the distance as a share
of the greatest possible distance.

``learn_profiles`` counts over every labelled training row: each task merges its own
counts, a partial aggregate sums them, and a ranked window with a group limit keeps
``size`` n-grams a language. Only those lists reach the driver: at most ``size``
times the number of languages rows, and more than ``MAX_LANGUAGES`` languages is an
error rather than a cut.

Defined results: null text or no letter: ``und`` with score 0; the same where nothing
could be learned. A training row needs a text, a language and an id. Every input row
gives one row. Extra columns are kept out of the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import Tally

SIZE = 400
SLICE = 1_000  # rows of one result batch
MAX_LANGUAGES = 5_000
UNKNOWN = "und"
PIECE = 1 << 20
_BLANK = re.compile(r"\s")


def held_out(id_col: str, mod: int, rest: int) -> Column:
    """Whether crc32 of the id as text leaves ``rest``; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % mod == rest, F.lit(False))


def _letters(text: str) -> np.ndarray:
    """Code points of a lower-cased text with every run of other characters as one 1, also at both ends."""
    low = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    if not len(low):
        return low
    kinds = np.flatnonzero(np.bincount(low))
    good = np.array([unicodedata.category(chr(c))[0] in "LM" for c in kinds])
    table = np.ones(int(kinds[-1]) + 1, np.int64)
    table[kinds[good]] = kinds[good]
    if not any(chr(c).isalpha() for c in kinds):
        return low[:0]
    out = np.concatenate(([1], table[low], [1]))
    return out[np.concatenate(([True], (out[1:] != 1) | (out[:-1] != 1)))]


def gram_codes(text: str) -> np.ndarray:
    """All one- to three-letter n-grams of a text as exact 63-bit codes; empty without a letter."""
    s = _letters(text)
    if not len(s):
        return s
    two = s[:-1] | s[1:] << 21
    three = (two[:-1] | s[2:] << 42)[s[1:-1] != 1]
    return np.concatenate((s[s != 1], two, three))


def pieces(text: str) -> Iterator[str]:
    """A text in pieces of about ``PIECE`` characters that end at white space, so no word is cut."""
    at = 0
    while len(text) - at > PIECE:
        cut = _BLANK.search(text, at + PIECE)
        if not cut:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:] if at else text


def ranked(text: str, size: int) -> np.ndarray:
    """The ``size`` most frequent n-gram codes of a whole text, most frequent first, ties by code."""
    if len(text) <= PIECE:
        codes, counts = np.unique(gram_codes(text), return_counts=True)
    else:
        tally = Tally(100_000)
        for piece in pieces(text):
            tally.add(gram_codes(piece))
        codes, counts = tally.merge()
    return codes[np.argsort(-counts, kind="stable")[:size]]


def _count(batches):
    tallies: dict[str, Tally] = {}
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            text = text.as_py()
            t = tallies.setdefault(lang, Tally(100_000))
            for piece in pieces(text):
                t.add(gram_codes(piece))
        pa.default_memory_pool().release_unused()  # an idle worker keeps what its pool holds
    for lang, t in tallies.items():
        keys, counts = t.merge()
        for i in range(0, len(keys), 100_000):
            n = len(keys[i:i + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(keys[i:i + 100_000]), pa.array(counts[i:i + 100_000])],
                                             ["lang", "gram", "n"])


def learn_profiles(rows: DataFrame, size: int = SIZE, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """``language -> n-gram codes by rank`` from all rows with a text and a language."""
    counts = (rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
              .where("lang is not null and text is not null")
              .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size).select("lang", "rank", "gram")
    out: dict[str, list[int]] = {}
    for r in best.orderBy("lang", "rank").limit(size * MAX_LANGUAGES + 1).collect():
        out.setdefault(r["lang"], []).append(r["gram"])
    if len(out) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return out


class Judge:
    """Out-of-place distances of texts to all profiles at once."""

    def __init__(self, profiles: dict[str, list[int]], size: int):
        self.names, self.size = sorted(profiles), size
        self.codes = np.unique(np.concatenate([np.array(profiles[n], np.int64) for n in self.names])) if self.names else np.zeros(0, np.int64)
        self.ranks = np.full((len(self.codes), len(self.names)), -1, np.int64)
        for j, n in enumerate(self.names):
            at = np.searchsorted(self.codes, np.array(profiles[n], np.int64))
            self.ranks[at, j] = np.arange(len(at))

    def __call__(self, text: str | None) -> tuple[str, float]:
        own = ranked(text, self.size) if text and self.names else ()
        if not len(own):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        ranks = np.where((self.codes[at] == own)[:, None], self.ranks[at], -1)
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))[:, None])).sum(axis=0)
        best = int(np.argmin(away))
        return self.names[best], 1.0 - float(away[best]) / (self.size * len(own))


def _judge(shared, size: int, names: tuple[str, str], text_at: int, kept: int):
    def run(batches):
        judge = Judge(shared.value, size)
        for b in batches:
            for a in range(0, b.num_rows, SLICE):
                part = b.slice(a, SLICE)
                found = [judge(t.as_py()) for t in part.column(text_at)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:kept], pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())],
                    [*part.schema.names[:kept], *names])
            pa.default_memory_pool().release_unused()
    return run


def predict(docs: DataFrame, profiles: dict[str, list[int]], keep: list[str], size: int = SIZE, text_col: str = "text",
            out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with the predicted language and its score for every row; no other column is read."""
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    cols = [F.col(f"`{c}`") for c in keep]
    if text_col not in keep or docs.schema[text_col].dataType.simpleString() != "string":  # else the kept text is read: it travels once
        cols.append(F.col(f"`{text_col}`").cast("string").alias("_text"))
    rows = docs.select(*cols)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:len(keep)]]
    text_at = keep.index(text_col) if len(cols) == len(keep) else len(keep)
    return rows.mapInArrow(_judge(shared, size, out, text_at, len(keep)), ", ".join([*fields, f"`{out[0]}` string", f"`{out[1]}` double"]))


def identify(docs: DataFrame, mod: int = 4, rest: int = 2, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)``: learned from the rows that are not held out, predicted for all."""
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.col(f"`{lang_col}`").alias("lang"),
                       held_out(f"`{id_col}`", mod, rest).alias("held_out"))
    profiles = learn_profiles(docs.where(~F.col("held_out") & F.col("doc_id").isNotNull()), size)
    return predict(docs, profiles, ["doc_id", "held_out"], size)
