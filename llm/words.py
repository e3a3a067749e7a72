"""Vectorised word and shingle hashing of Arrow text batches.

A batch's texts lie one after the other in one UTF-8 buffer, so words are found
and hashed for many documents at once with numpy, never per row. All separators
of the two word rules are ASCII, hence the byte rules below equal the code point
rules ``[^\\x20\\x09-\\x0D]+`` (SPACE) and ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (ALNUM).

Memory: texts are taken in runs of at most ``CHUNK_BYTES`` (a longer text alone
makes a run), so a task's working set does not follow the batch size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SPACE = np.ones(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240607)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser (bijective), vectorised."""
    x = x ^ U((salt * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of the base and of its inverse mod 2^64; the usual length stays in memory."""
    if n <= CHUNK_BYTES + 1:
        n = CHUNK_BYTES + 1
        if n in _POWERS:
            return _POWERS[n]
    out = []
    for base in (_BASE, _INV):
        p = np.full(n, base, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    if n == CHUNK_BYTES + 1:
        _POWERS[n] = (out[0], out[1])
    return out[0], out[1]


def text_runs(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, bytes, offsets)`` of consecutive texts; a null text has no bytes."""
    if pa.types.is_large_string(column.type) or pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i, n = 0, len(column)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j
    pa.default_memory_pool().release_unused()  # what earlier batches held counts against the executor's memory


def word_spans(data: np.ndarray, offs: np.ndarray, rule: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(lower-cased bytes, word starts, word ends, first word of each text plus the total)``."""
    low = _LOWER[data]
    if not len(low):
        z = np.zeros(0, np.int64)
        return low, z, z, np.zeros(len(offs), np.int64)
    inside = rule[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[offs] = True
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return low, starts, ends, np.searchsorted(starts, offs)


def word_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over random byte values, then mixed with the length."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(len(low) + 1)
    total = np.zeros(len(low) + 1, dtype=U)
    np.cumsum(_BYTE[low] * up[:len(low)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def gram_hashes(words: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``k`` words (``len(words) - k + 1`` values)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(k + 1), dtype=U)
    for i in range(k):
        out = out * U(0x9FB21C651E98DF25) + words[i:i + n]
    return mix(out, salt)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``k``-word shingle hashes of each text; fewer words: the whole run; none: empty."""
    grams = gram_hashes(words, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(grams[a:b - k + 1])
            yield s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            yield gram_hashes(words[a:b], b - a)
        else:
            yield np.zeros(0, U)


def grams_at(words: np.ndarray, at: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    """The ``gram_hashes`` of the runs that start at the given words."""
    out = np.full(len(at), U(k + 1), dtype=U)
    for i in range(k):
        out = out * U(0x9FB21C651E98DF25) + words[at + i]
    return mix(out, salt)


class Tally:
    """Counts of 64-bit keys; repeated keys are merged as soon as they pile up."""

    def __init__(self, pile: int = 2_000_000):
        self.pile, self.keys, self.counts, self.waiting = pile, [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        if counts is None:
            keys, counts = np.unique(keys, return_counts=True)
        self.keys.append(keys)
        self.counts.append(counts)
        self.waiting += len(keys)
        if self.waiting > self.pile:
            self.merge()
            self.pile = max(self.pile, 2 * len(self.keys[0]))

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cut = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        keys, counts = keys[cut], (np.add.reduceat(counts[order], cut) if len(cut) else counts)
        self.keys, self.counts, self.waiting = [keys], [counts], len(keys)
        return keys, counts
