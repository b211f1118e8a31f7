"""Maximal runs: stretches of words that repeat with a period, found over a suffix tree of each text.

Tasks cut their rows into words and build the suffix trees of a slice of texts at once, in
NumPy: words of different rows are different symbols, so the trees of a slice are a forest
in one suffix array.  Its order comes from doubling, in which only suffixes that still tie are
sorted again; the lengths of common prefixes come from the ranks of each doubling; an inner
node is an interval of the array between smaller prefixes, found by halving.

Of each inner node with string depth D, the leaves outside its largest child are visited (each
leaf at most log n times).  A leaf i with i + D, or i - D, under the same node but another child
is a branching tandem repeat of period D: its two halves are equal and the next word ends the repetition.
So it stands at the right end of its run.  It is rotated to the left as long as words
agree, which gives the run; repeats of one run with multiples of its period merge into it.

Defined cases: a null text, one without words and one shorter than the least length have no
run and stay as they are, without blanks that divide nothing; every row is judged by itself, also without
doc_id and repeated ones; texts of any length are read whole, a task holds one slice or one longer text;
columns other than doc_id and text are left out, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import tokens

#: A run has so many words at least, and twice its period.
MIN_WORDS = 12
SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def suffix_ranks(symbols: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The suffix array of rows of symbols (``end``: where each position's row ends), and the ranks after each
    doubling: equal where the first 2**k symbols are.  Symbols of different rows must differ."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    head = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    at = np.arange(n)
    first = np.maximum.accumulate(np.where(head, at, 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    levels, width = [rank.astype(np.int32)], 1
    # places whose first `width` symbols tie with a neighbour's
    open_ = ~(head & np.concatenate((head[1:], [True])))
    while open_.any():
        places = np.flatnonzero(open_)
        who = order[places]
        after = who + width
        inside = after < end[who]
        key = rank[who] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[places] = who
        new = np.concatenate(([True], key[1:] != key[:-1]))
        groups = np.maximum.accumulate(np.where(new, np.arange(len(places)), 0))
        rank[who] = places[groups]
        open_[places] = ~(new & np.concatenate((new[1:], [True])))
        width *= 2
        levels.append(rank.astype(np.int32))
    return order, levels


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray) -> np.ndarray:
    """For each place of the suffix array, the symbols that its suffix shares with the one before it."""
    n = len(order)
    a, b = order[:-1].copy(), order[1:].copy()
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    for k in reversed(range(len(levels) - 1)):
        x, y = a[live], b[live]
        ok = (x < n) & (y < n)
        ok[ok] = levels[k][x[ok]] == levels[k][y[ok]]
        hit = live[ok]
        out[hit + 1] += 1 << k
        a[hit] += 1 << k
        b[hit] += 1 << k
    return out


def _lowest(x: np.ndarray, most: int) -> list[np.ndarray]:
    """Minima of the 1, 2, 4, .. values from each place on; beyond the end counts as -1."""
    out, width = [x], 1
    while width <= most:
        low = np.full(len(x), -1, x.dtype)
        if width < len(x):
            low[:-width] = np.minimum(out[-1][:-width], out[-1][width:])
        out.append(low)
        width *= 2
    return out


def _next_below(low: list[np.ndarray], at: np.ndarray, than: np.ndarray, or_equal: bool) -> np.ndarray:
    """The next place after each of ``at`` that holds less than ``than`` (or as much); the length if none does."""
    pos, n = at + 1, len(low[0])
    for k in reversed(range(len(low))):
        got = low[k][np.minimum(pos, n - 1)]
        skip = (got > than if or_equal else got >= than) & (pos < n)
        pos[skip] += 1 << k
    return np.minimum(pos, n)


def tandem_repeats(symbols: np.ndarray, end: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every branching tandem repeat, by the smaller children of each inner node."""
    none = np.zeros(0, np.int64)
    n = len(symbols)
    if n < 2:
        return none, none
    order, levels = suffix_ranks(symbols, end)
    common = common_prefixes(order, levels, end)
    del levels
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    cut = np.flatnonzero(common)  # a boundary between two children of a node
    if not len(cut):
        return none, none
    depth = common[cut]
    low = _lowest(common, longest)
    right = _next_below(low, cut, depth, False)
    child_right = _next_below(low, cut, depth, True)
    del low
    back = _lowest(common[::-1], longest)
    left = n - 1 - _next_below(back, n - 1 - cut, depth, False)
    del back
    # boundaries by node; its children lie before the first boundary and after each
    by = np.argsort(left * (n + 1) + right, kind="stable")
    key = (left * (n + 1) + right)[by]
    first = np.concatenate(([True], key[1:] != key[:-1]))
    node = np.cumsum(first) - 1
    heads = by[first]
    child_node = np.concatenate((node, np.arange(len(heads))))
    child_lo = np.concatenate((cut[by], left[heads]))
    child_hi = np.concatenate((child_right[by], cut[heads]))  # exclusive
    node_lo, node_hi, node_depth = left[heads], right[heads], depth[heads]
    size = child_hi - child_lo
    by = np.lexsort((size, child_node))
    small = by[:-1][child_node[by][1:] == child_node[by][:-1]]  # all but the largest of each node
    # a leaf of every small child, with its node and child
    count = size[small]
    total = int(count.sum())
    offset = np.cumsum(count) - count
    starts, periods = [], []
    for lo, hi in _parts(offset, total):
        c = np.repeat(small[lo:hi], count[lo:hi])
        leaf = order[np.arange(len(c)) - np.repeat(offset[lo:hi] - offset[lo], count[lo:hi]) + child_lo[c]]
        v = child_node[c]
        d = node_depth[v]
        for other, start in ((leaf + d, leaf), (leaf - d, leaf - d)):
            ok = (other >= 0) & (other < end[leaf])
            there = place[np.where(ok, other, 0)]
            ok &= (there >= node_lo[v]) & (there < node_hi[v]) & ((there < child_lo[c]) | (there >= child_hi[c]))
            starts.append(start[ok])
            periods.append(d[ok])
    start, period = np.concatenate(starts), np.concatenate(periods)
    both = np.unique(start * (n + 1) + period)
    return both // (n + 1), both % (n + 1)


def _parts(offset: np.ndarray, total: int, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Stretches of children with about ``most`` leaves together (or one larger child)."""
    lo = 0
    while lo < len(offset):
        hi = max(lo + 1, int(np.searchsorted(offset, offset[lo] + most)))
        yield lo, min(hi, len(offset))
        lo = hi


def _rotations(symbols: np.ndarray, start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """How far each repeat moves to the left while words agree, looking at 1, 2, 4, .. words at a time."""
    out = np.zeros(len(start), np.int64)
    live, width = np.arange(len(start)), 1
    while len(live):
        at = (start[live] - out[live])[:, None] - 1 - np.arange(width)
        same = (at >= 0) & (symbols[np.maximum(at, 0)] == symbols[np.maximum(at, 0) + period[live][:, None]])
        full = same.all(axis=1)
        out[live] += np.where(full, width, same.argmin(axis=1))
        live, width = live[full], min(2 * width, 1 << 12)
    return out


def maximal_runs(symbols: np.ndarray, end: np.ndarray, longest: int, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal runs of ``least`` words or more, by start and period."""
    start, period = tandem_repeats(symbols, end, longest)
    stop = start + 2 * period
    by = np.lexsort((period, stop))
    start, period, stop = start[by], period[by], stop[by]
    found = []
    while len(start):
        # the least period at each end is the run's own; multiples of it inside the run are the same run
        head = np.concatenate(([True], stop[1:] != stop[:-1]))
        group = np.cumsum(head) - 1
        s, q, e = start[head], period[head], stop[head]
        s = s - _rotations(symbols, s, q)
        found.append((s, e, q))
        merged = (period % q[group] == 0) & (2 * period <= (e - s)[group])
        start, period, stop = start[~merged], period[~merged], stop[~merged]
    if not found:
        return start, stop, period
    s, e, q = (np.concatenate(x) for x in zip(*found))
    long = e - s >= least
    s, e, q = s[long], e[long], q[long]
    by = np.lexsort((q, s))
    return s[by], e[by], q[by]


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, n_rows: int) -> pa.Array:
    """The words of each row joined by one space."""
    last = np.concatenate((row[1:] != row[:-1], [True]))[: len(row)]
    length = end - start + ~last
    to = np.cumsum(length)
    out = np.append(data, np.uint8(32))[np.minimum(np.arange(int(length.sum())) + np.repeat(start - (to - length), length), len(data))]
    out[to[~last] - 1] = 32
    offsets = np.zeros(n_rows + 1, np.int64)
    np.add.at(offsets, row + 1, length)
    return pa.LargeStringArray.from_buffers(n_rows, pa.py_buffer(np.cumsum(offsets)), pa.py_buffer(out)).cast(pa.string())


def _slice(part: pa.RecordBatch, words: tokens.Words, least: int) -> pa.RecordBatch:
    row, n = words.row, len(words.hash)
    counts = words.counts
    symbols = tokens.mix(words.hash + tokens.mix(row.astype(np.uint64) + np.uint64(1)))
    end = np.repeat(words.first[1:], counts)
    s, e, q = maximal_runs(symbols, end, int(counts.max(initial=0)), least)
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, s + q, 1)
    np.add.at(gone, e, -1)
    kept = np.cumsum(gone[:n]) == 0
    at = row[s] if len(s) else s
    first = np.searchsorted(at, np.arange(words.n_rows + 1))
    fields = pa.StructArray.from_arrays([pa.array(s - words.first[at]), pa.array(e - s), pa.array(q)], ["start", "length", "period"])
    return pa.RecordBatch.from_arrays(
        [
            part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), pa.array(counts.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), fields), _joined(words.data, words.start[kept], words.end[kept], row[kept], words.n_rows),
        ],
        ["doc_id", "n_words", "runs", "collapsed"],
    )


def find(docs: DataFrame, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed): all maximal runs of ``least`` words or more, as
    word numbers from 0, and the text without the words that a run repeats after its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in tokens.slices(batch, "text"):
                yield _slice(part, words, least)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
