"""Vectorised views of Arrow text columns: words, hashes, n-grams.

A column of texts is handled as one byte array with document offsets, in slices
of a few megabytes, so memory in a worker follows the slice (or the longest
single text), never the batch or the partition.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4 << 20
SMALL_SLICE = 1 << 20  # where a worker also holds a model: arrays of a slice take some 30 times its bytes

_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(0, 2**64, 256, dtype=np.uint64)
GRAM_KEYS = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_set(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


WHITE = byte_set(b"\x20\x09\x0a\x0b\x0c\x0d")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(column: pa.Array, most: int = SLICE_BYTES):
    """Yields (first row, one past the last row, bytes, offsets) over a text
    column; null texts are empty.  A slice holds about `most` bytes or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of True that stay within a document: starts, ends, and for each
    document the first of its runs (one entry more than documents)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = offsets[(offsets > 0) & (offsets < len(inside))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each (disjoint, ascending) span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    begin = np.cumsum(lens) - lens
    size = int(lens.sum())
    small = np.int32 if len(data) < 1 << 31 else np.int64
    at = np.arange(size, dtype=small)
    at -= np.repeat(begin.astype(small), lens)  # place of each byte in its span
    values = np.cumprod(np.full(int(lens.max()) + 1, BASE, np.uint64))[at]
    at += np.repeat(starts.astype(small), lens)
    values *= BYTE_KEYS[data[at]]
    del at
    full = lens > 0
    out = np.zeros(len(starts), np.uint64)
    out[full] = np.add.reduceat(values, begin[full])
    return mix(out + lens.astype(np.uint64))


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows inside documents; first[d] is the first word
    of document d.  Returns the hashes and the word each window starts at."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total += words[k : len(words) - n + 1 + k] * GRAM_KEYS[k]
    fits = np.ones(len(total), bool)
    for k in range(1, n):  # a window that starts k words before a document's end leaves it
        late = first[1:] - k
        fits[late[(late >= 0) & (late < len(total)) & (late >= first[:-1])]] = False
    # windows that start in a document shorter than n are all marked by the loop above
    at = np.flatnonzero(fits)
    return mix(total[at]), at


def per_document(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values (one per word) by document."""
    total = np.concatenate([np.zeros(1, np.result_type(values, np.int64)), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


class WordCache:
    """Maps word hashes to rows of a store that grows as new words are met.

    At most `most` words are held; beyond that the store starts anew, so the
    memory of a worker is bounded and results never depend on it.
    """

    def __init__(self, compute, most: int = 1_000_000):
        self.compute, self.most = compute, most
        self.keys, self.rows, self.store = np.zeros(0, np.uint64), np.zeros(0, np.int64), None

    def look_up(self, data, starts, ends):
        """Returns (store, row of each span)."""
        hashes = span_hashes(data, starts, ends)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > self.most:
            self.keys, self.rows, self.store = self.keys[:0], self.rows[:0], None
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        rows = np.zeros(len(keys), np.int64)
        rows[known] = self.rows[at[known]]
        if not known.all():
            new = where[~known]
            raw = data.tobytes()
            words = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[new].tolist(), ends[new].tolist())]
            self.store, got = self.compute(self.store, words)
            rows[~known] = got
            keys_all = np.concatenate([self.keys, keys[~known]])
            order = np.argsort(keys_all, kind="stable")
            self.keys, self.rows = keys_all[order], np.concatenate([self.rows, got])[order]
        return self.store, rows[back.reshape(-1)]


class Ragged:
    """Rows of unequal length, appended in blocks."""

    def __init__(self, dtype):
        self.values, self.offsets = np.zeros(0, dtype), np.zeros(1, np.int64)

    def append(self, values: np.ndarray, lens: np.ndarray) -> np.ndarray:
        before = len(self.offsets) - 1
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lens)])
        self.values = np.concatenate([self.values, values.astype(self.values.dtype, copy=False)])
        return np.arange(before, before + len(lens))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of the rows end to end, and each row's length."""
        lens = (self.offsets[1:] - self.offsets[:-1])[rows]
        begin = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum()), dtype=np.int64) - np.repeat(begin - self.offsets[:-1][rows], lens)
        return self.values[at], lens
