"""Words and word n-grams of Arrow text columns as NumPy arrays.

A helper for tasks of ``mapInArrow``: a slice of rows is cut into words with a
byte table and every word gets a 64-bit hash, with no Python loop over words.
A null text has no words.  A slice holds about ``SLICE_BYTES`` of text (or one
longer text), so that memory doesn't depend on the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of splitmix64)."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _table(word: str) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: is it part of a word, and what it counts as."""
    code = np.arange(256)
    as_is = code.copy()
    if word == "space":  # [^\x20\x09-\x0D]+
        inside = ~((code == 0x20) | ((code >= 0x09) & (code <= 0x0D)))
    elif word == "alnum":  # A-Z lower-cased, then [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
        as_is[65:91] += 32
        inside = ((code >= 48) & (code <= 57)) | ((as_is >= 97) & (as_is <= 122)) | (code >= 128)
    elif word == "lower":  # as "space", A-Z lower-cased
        as_is[65:91] += 32
        inside = ~((code == 0x20) | ((code >= 0x09) & (code <= 0x0D)))
    else:
        raise ValueError(f"unknown kind of word: {word}")
    return inside, mix(as_is.astype(np.uint64) + np.uint64(1))


@lru_cache(maxsize=8)
def table(word: str):
    return _table(word)


@lru_cache(maxsize=8)
def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(size, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(20, int(n).bit_length()))


class Words:
    """The words of some rows: ``first[i]:first[i+1]`` are those of row i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, word: str):
        inside, code = table(word)
        self.data, self.offsets = data, offsets
        self.n_rows = len(offsets) - 1
        n = len(data)
        if n == 0:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            self.first = np.zeros(self.n_rows + 1, np.int64)
            return
        m = inside[data]
        cut = np.zeros(n + 1, bool)
        cut[offsets] = True
        begins, ends = m.copy(), m.copy()
        begins[1:] &= ~m[:-1] | cut[1:n]
        ends[:-1] &= ~m[1:] | cut[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        up, down = powers(_BYTE_BASE, n + 1)
        total = np.empty(n + 1, np.uint64)
        total[0] = 0
        np.cumsum(code[data] * up[:n], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offsets)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(self.n_rows), self.counts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the k words from each word on, and which of them stay within a row."""
        n = len(self.hash)
        out, ok = np.zeros(n, np.uint64), np.zeros(n, bool)
        if n >= k:
            up, down = powers(_WORD_BASE, n + 1)
            total = np.empty(n + 1, np.uint64)
            total[0] = 0
            np.cumsum(self.hash * up[:n], out=total[1:])
            m = n - k + 1
            out[:m] = mix((total[k:] - total[:m]) * down[:m] + np.uint64(k))
            ok[:m] = np.arange(k, n + 1) <= np.repeat(self.first[1:], self.counts)[:m]
        return out, ok

    def bytes_of(self, i: int, j: int) -> bytes:
        """Words i to j - 1 of one row, joined by one space."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.start[i:j], self.end[i:j]))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def slices(batch: pa.RecordBatch, column: str, word: str = "space", limit: int = 0) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """The batch in slices of about ``limit`` bytes of text, with their words."""
    if batch.num_rows == 0:
        return
    limit = limit or SLICE_BYTES
    data, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, batch.num_rows)
        part = data[offsets[lo] : offsets[hi]]
        yield batch.slice(lo, hi - lo), Words(part, offsets[lo : hi + 1] - offsets[lo], word)
        lo = hi


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each place on (the last width - 1 places see fewer)."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:]) if step < len(out) else out[: len(out) - step]
        have += step
    return out


def long_column(values: np.ndarray) -> pa.Array:
    """64-bit hashes as Spark's signed long."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))
