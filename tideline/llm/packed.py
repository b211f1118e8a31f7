"""Many small rows of whole numbers as a few rows of bytes, for shuffles.

A helper for tasks: columns of 64-bit numbers become blobs of runs of their rows.  Each number takes
as many bytes as it needs, none for a zero, so differences of sorted keys and small counts are short.
All is done by columns; there is no Python loop over rows or blobs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tideline.llm import tokens

#: The columns of blobs of four numbers a row.
NAMES = ["lengths", "more", "data"]
SCHEMA = ", ".join(f"{c} binary" for c in NAMES)


def _lengths(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint8)
    most = int(x.max()).bit_length() if len(x) else 0
    for j in range(0, most, 8):
        out += (x >> np.uint64(j)) != 0
    return out


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def pack(ends: np.ndarray, columns: list[np.ndarray]) -> list[pa.Array]:
    """Blobs (``SCHEMA``) of the rows ends[i]:ends[i + 1] of four columns of unsigned 64-bit numbers."""
    sizes = [_lengths(c) for c in columns]
    upto = np.zeros(len(columns[0]) + 1, np.int64)
    np.cumsum(sum(n.astype(np.int64) for n in sizes), out=upto[1:])
    data = np.zeros(upto[-1], np.uint8)
    at = upto[:-1].copy()
    for c, n in zip(columns, sizes):
        for j in range(int(n.max()) if len(n) else 0):
            i = np.flatnonzero(n > j)
            data[at[i] + j] = (c[i] >> np.uint64(8 * j)).astype(np.uint8)
        at += n
    return [_binary(ends, sizes[0] | sizes[1] << 4), _binary(ends, sizes[2] | sizes[3] << 4), _binary(upto[ends], data)]


def unpack(blobs: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ends of the blobs' rows, and the four columns."""
    first, more, data = (tokens.buffers(blobs.column(c)) for c in NAMES)
    first, more, data, ends = *(d[o[0] : o[-1]] for d, o in (first, more, data)), first[1] - first[1][0]
    sizes = [x >> s & 15 for x in (first, more) for s in (0, 4)]
    at = np.zeros(len(first), np.int64)
    np.cumsum(sum(n.astype(np.int64) for n in sizes)[:-1], out=at[1:])
    out = []
    for n in sizes:
        c = np.zeros(len(n), np.uint64)
        for j in range(int(n.max()) if len(n) else 0):
            i = np.flatnonzero(n > j)
            c[i] |= data[at[i] + j].astype(np.uint64) << np.uint64(8 * j)
        at += n
        out.append(c)
    return ends, out


def steps(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The differences of numbers that ascend, from zero wherever ``new`` is set (modulo 2**64)."""
    out = x.copy()
    out[1:] -= np.where(new[1:], np.uint64(0), x[:-1])
    return out


def summed(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The inverse of ``steps``."""
    total = np.cumsum(x, dtype=np.uint64)
    at = np.flatnonzero(new)
    return total - np.repeat(total[at] - x[at], np.diff(np.r_[at, len(x)]))


def pack_pairs(ends: np.ndarray, v: np.ndarray, w: np.ndarray, *rest: np.ndarray) -> list[pa.Array]:
    """Blobs of rows whose (v, w) ascend, and of two more columns."""
    new = np.zeros(len(v), bool)
    new[ends[:-1]] = True
    dv = steps(v, new)
    return pack(ends, [dv, steps(w, new | (dv != 0)), *rest])


def unpack_pairs(blobs: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The ends of the blobs' rows, and v, w and the two other columns."""
    ends, (dv, dw, *rest) = unpack(blobs)
    new = np.zeros(len(dv), bool)
    new[ends[:-1]] = True
    return ends, [summed(dv, new), summed(dw, new | (dv != 0)), *rest]
