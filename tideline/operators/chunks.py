"""Filters, smoothers and likelihoods of series of any length, by chunks of time.

A series is cut into chunks of ``size`` steps, each a row.  What a chunk does to the
state that enters it is one element of a few small matrices, whatever its length:
x_out = A x_in + b + N(0, C), and what its observations say of x_in, exp(eta x - x'J x / 2).
Elements combine associatively, so the states that enter all chunks come from a prefix scan:
blocks of elements are combined in parallel, level by level, and the states go back down.
Then every chunk is filtered by itself.  Smoothing runs the same way backwards, where a chunk
takes u and N to Phi'u + c and Phi'N Phi + D.

A task holds some chunks at a time and steps through them side by side in NumPy; memory is that of
chunks, not of series, and no array grows.  ``t`` must be whole numbers one apart (see ``importance.check``).
Defined cases: an empty table gives none; a channel of one row is one chunk; extra columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.plans.model import Plan
from tideline.sources.scratch import settle

#: Steps in a chunk, elements in a block of the scan, and bytes of states that a task keeps at a time.
SIZE, FAN, BYTES = 1024, 64, 64 << 20
ROWS = "channel string, t int, m array<double>, p array<double>, am array<double>, ap array<double>, v double, s double"


class Matrices:
    """A plan's matrices as arrays."""

    def __init__(self, plan: Plan):
        self.d, self.features, self.loading = len(plan.names), list(plan.features), plan.loading
        self.f, self.mean, self.cov = np.array(plan.transition), np.array(plan.mean), np.array(plan.cov)
        self.noise = np.array([sum((np.outer(c, c) for c in cols), np.zeros((self.d, self.d))) for cols in plan.noise.values()]).reshape(-1, self.d, self.d)

    def loadings(self, x: np.ndarray | None, shape: tuple[int, int]) -> np.ndarray:
        """(chunks, steps, states)."""
        out = np.empty((*shape, self.d))
        for i, h in enumerate(self.loading):
            out[..., i] = x[..., self.features.index(h)] if isinstance(h, str) else h
        return out


class Chunks:
    """Some chunks side by side: y, r (chunks, steps), h (chunks, steps, states), q (chunks, states, states), n steps of each."""

    def __init__(self, batch: pa.RecordBatch, plan: Matrices):
        column = lambda name: batch.column(batch.schema.get_field_index(name))
        t = column("t")
        self.n = np.diff(t.offsets.to_numpy())
        self.t, width = t.flatten().to_numpy(), int(self.n.max(initial=0))
        self.there = np.arange(width) < self.n[:, None]

        def padded(name: str, k: int | None = None) -> np.ndarray:
            values = column(name).flatten().to_numpy(zero_copy_only=False).astype(float)
            out = np.ones((len(self.n), width) if k is None else (len(self.n), width, k))
            out[self.there] = values if k is None else values.reshape(-1, k)
            return out

        self.y, self.r = padded("y"), padded("r")
        self.h = plan.loadings(padded("x", len(plan.features)) if plan.features else None, self.y.shape)
        groups = column("q").flatten().to_numpy().reshape(len(self.n), -1)
        self.q = np.einsum("bg,gij->bij", groups, plan.noise) if len(plan.noise) else np.zeros((len(self.n), plan.d, plan.d))


def _steps(plan: Matrices, c: Chunks, m: np.ndarray, p: np.ndarray) -> Iterator[tuple]:
    """The filter from states m, p that enter: (step, which chunks, am, ap, h, gain, error, its variance, m, p) after each step."""
    m, p, f = m.copy(), p.copy(), plan.f
    for k in range(c.y.shape[1]):
        b = np.flatnonzero(c.there[:, k])
        am = m[b] @ f.T
        ap = f @ p[b] @ f.T + c.q[b]
        h = c.h[b, k]
        ph = np.einsum("bij,bj->bi", ap, h)
        s = np.einsum("bi,bi->b", ph, h) + c.r[b, k]
        v = c.y[b, k] - np.einsum("bi,bi->b", am, h)
        gain = ph / s[:, None]
        m[b] = am + gain * v[:, None]
        p[b] = ap - gain[:, :, None] * ph[:, None, :]
        yield k, b, am, ap, h, gain, v, s, m[b], p[b]


def _forward_elements(plan: Matrices, c: Chunks) -> np.ndarray:
    """(chunks, numbers) of A, b, C, eta, J."""
    n, d = len(c.n), plan.d
    a, eta, j = np.broadcast_to(np.eye(d), (n, d, d)).copy(), np.zeros((n, d)), np.zeros((n, d, d))
    b, cov = np.zeros((n, d)), np.zeros((n, d, d))
    # a chunk entered by a known state, zero; what the state changes goes through A
    for _, at, _, _, h, gain, v, s, m, p in _steps(plan, c, b, cov):
        fa = plan.f @ a[at]
        ha = np.einsum("bi,bij->bj", h, fa)
        eta[at] += ha * (v / s)[:, None]
        j[at] += ha[:, :, None] * ha[:, None, :] / s[:, None, None]
        a[at] = fa - gain[:, :, None] * ha[:, None, :]
        b[at], cov[at] = m, p
    return np.concatenate([a.reshape(n, -1), b, cov.reshape(n, -1), eta, j.reshape(n, -1)], 1)


def _split(e: np.ndarray, d: int) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(e):
        square = len(out) % 2 == 0
        size = d * d if square else d
        out.append(e[at : at + size].reshape(d, d) if square else e[at : at + size])
        at += size
    return out


def _join(*parts: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ravel(x) for x in parts])


def forward_combine(one: np.ndarray, two: np.ndarray, d: int) -> np.ndarray:
    """The element of two stretches, the first one before."""
    (a1, b1, c1, e1, j1), (a2, b2, c2, e2, j2) = _split(one, d), _split(two, d)
    x = np.linalg.solve(np.eye(d) + c1 @ j2, np.concatenate([a1, (b1 + c1 @ e2)[:, None], c1], 1))
    y = np.linalg.solve(np.eye(d) + j2 @ c1, np.concatenate([(e2 - j2 @ b1)[:, None], j2 @ a1], 1))
    return _join(a2 @ x[:, :d], a2 @ x[:, d] + b2, a2 @ x[:, d + 1 :] @ a2.T + c2, a1.T @ y[:, 0] + e1, a1.T @ y[:, 1:] + j1)


def forward_act(e: np.ndarray, state: np.ndarray, d: int) -> np.ndarray:
    """The state (P, m) after a stretch."""
    (a, b, c, eta, j), (p, m) = _split(e, d), _split(state, d)
    x = np.linalg.solve(np.eye(d) + p @ j, np.concatenate([(m + p @ eta)[:, None], p], 1))
    return _join(a @ x[:, 1:] @ a.T + c, a @ x[:, 0] + b)


def backward_combine(one: np.ndarray, two: np.ndarray, d: int) -> np.ndarray:
    """The element (Phi, c, D) of two stretches, the first one later in time."""
    (f1, c1, d1), (f2, c2, d2) = _split(one, d), _split(two, d)
    return _join(f1 @ f2, f2.T @ c1 + c2, f2.T @ d1 @ f2 + d2)


def backward_act(e: np.ndarray, state: np.ndarray, d: int) -> np.ndarray:
    """(N, u) before a stretch from those after it."""
    (f, c, dd), (n, u) = _split(e, d), _split(state, d)
    return _join(f.T @ n @ f + dd, f.T @ u + c)


def prefix(elements: DataFrame, start: list[float], combine: Callable, act: Callable, d: int, fan: int = FAN) -> DataFrame:
    """(channel, at, state): the state before each element of (channel, at, e), in the order of ``at``.

    Blocks of ``fan`` elements are combined to one element each, until a channel has one block; then states come
    back down, from the start of the series to each block to each element.  A task has one block at a time."""
    levels = [settle(elements, "elements")]

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        e = np.asarray(g["e"].iloc[0])
        for x in g["e"].iloc[1:]:
            e = combine(e, np.asarray(x), d)
        return pd.DataFrame({"channel": [g["channel"].iloc[0]], "at": [g["block"].iloc[0]], "e": [e]})

    block = F.floor(F.col("at") / fan).cast("long")
    while levels[-1].groupBy("channel").count().where(f"count > {fan}").limit(1).count():
        blocks = levels[-1].withColumn("block", block).groupBy("channel", "block").applyInPandas(one, "channel string, at long, e array<double>")
        levels.append(settle(blocks, "elements"))

    def down(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("at")
        state, out = np.asarray(g["state"].iloc[0]), []
        for x in g["e"]:
            out.append(state)
            state = act(np.asarray(x), state, d)
        return pd.DataFrame({"channel": g["channel"], "at": g["at"], "state": out})

    kind = "channel string, at long, state array<double>"
    first = F.array(*map(F.lit, map(float, start)))
    state = levels[-1].withColumn("state", first).groupBy("channel").applyInPandas(down, kind)
    for level in reversed(levels[:-1]):
        x = level.withColumn("block", block).join(state.withColumnRenamed("at", "block"), ["channel", "block"])
        state = x.groupBy("channel", "block").applyInPandas(down, kind)
    return state


def cut(obs: DataFrame, plan: Plan, q: dict[str, Column | float], r: Column | float, size: int = SIZE) -> DataFrame:
    """(channel, chunk, t, y, r[, x], q) of obs (channel, t, y[, x]): arrays of up to ``size`` steps; ``q`` and ``r``: variances
    by noise group and of the observation, as numbers or columns of obs."""
    column = lambda c: (c if isinstance(c, Column) else F.lit(float(c))).cast("double")
    q_all = F.array(*(column(q[g]) for g in plan.noise)) if plan.noise else F.array().cast("array<double>")
    fields = [F.col("t").cast("int").alias("t"), F.col("y").cast("double").alias("y"), column(r).alias("r")]
    if plan.features:
        fields.append(F.col("x").alias("x"))
    x = obs.select(F.col("channel").cast("string").alias("channel"), F.floor(F.col("t") / size).cast("long").alias("chunk"), F.struct(*fields).alias("s"), q_all.alias("q"))
    x = x.groupBy("channel", "chunk").agg(F.array_sort(F.collect_list("s")).alias("s"), F.first("q").alias("q"))
    features = [F.flatten("s.x").alias("x")] if plan.features else []
    return settle(x.select("channel", "chunk", "s.t", "s.y", "s.r", *features, "q"), "chunks")


def _mapped(rows: DataFrame, plan: Matrices, body: Callable[[pa.RecordBatch, Chunks], pa.RecordBatch], schema: str) -> DataFrame:
    """``body`` of some chunks at a time, as many as ``BYTES`` of states allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps = np.diff(batch.column(batch.schema.get_field_index("t")).offsets.to_numpy())
            most = max(1, int(BYTES // (16 * plan.d**2 * max(1, steps.max(initial=1)))))
            for lo in range(0, batch.num_rows, most):
                part = batch.slice(lo, most)
                yield body(part, Chunks(part, plan))

    return rows.mapInArrow(run, schema)


def _lists(x: np.ndarray) -> pa.Array:
    """Rows of numbers as an Arrow list column."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))


def _states(part: pa.RecordBatch, name: str, d: int, square_first: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, matrices) that enter the chunks."""
    x = part.column(part.schema.get_field_index(name)).flatten().to_numpy().reshape(part.num_rows, d * d + d)
    return x[:, d * d :], x[:, : d * d].reshape(-1, d, d)


def _named(part: pa.RecordBatch, c: Chunks) -> pa.Array:
    return part.column(part.schema.get_field_index("channel")).take(pa.array(np.repeat(np.arange(len(c.n)), c.n)))


def entered(chunks: DataFrame, plan: Plan, fan: int = FAN) -> DataFrame:
    """The chunks with ``enters``: the covariance and mean of the state before each."""
    p = Matrices(plan)
    keyed = chunks.withColumn("at", F.col("chunk"))
    body = lambda part, c: pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("channel")), part.column(part.schema.get_field_index("at")), _lists(_forward_elements(p, c))], ["channel", "at", "e"])
    elements = _mapped(keyed, p, body, "channel string, at long, e array<double>")
    state = prefix(elements, _join(p.cov, p.mean).tolist(), forward_combine, forward_act, p.d, fan)
    return settle(chunks.join(state.select("channel", F.col("at").alias("chunk"), F.col("state").alias("enters")), ["channel", "chunk"]), "entered")


def filtered(obs: DataFrame, plan: Plan, q: dict[str, Column | float], r: Column | float, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(channel, t, m, p, am, ap, v, s): as ``state_space.forward``, a row a step."""
    p = Matrices(plan)

    def body(part: pa.RecordBatch, c: Chunks) -> pa.RecordBatch:
        n, w, d = len(c.n), c.y.shape[1], p.d
        out = {k: np.empty((n, w, *shape)) for k, shape in (("m", (d,)), ("p", (d * d,)), ("am", (d,)), ("ap", (d * d,)), ("v", ()), ("s", ()))}
        for k, b, am, ap, _, _, v, s, m, cov in _steps(p, c, *_states(part, "enters", d)):
            for name, value in (("m", m), ("p", cov), ("am", am), ("ap", ap), ("v", v), ("s", s)):
                out[name][b, k] = value.reshape(len(b), -1) if value.ndim > 1 else value
        long = {k: v[c.there] for k, v in out.items()}
        return pa.RecordBatch.from_arrays([_named(part, c), pa.array(c.t, pa.int32()), *(_lists(long[k]) if long[k].ndim > 1 else pa.array(long[k]) for k in out)], ["channel", "t", *out])

    return _mapped(entered(cut(obs, plan, q, r, size), plan, fan), p, body, ROWS)


def likelihood(obs: DataFrame, plan: Plan, q: dict[str, Column | float], r: Column | float, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(channel, loglik): chunks are summed in the tasks."""
    p = Matrices(plan)

    def body(part: pa.RecordBatch, c: Chunks) -> pa.RecordBatch:
        total = np.zeros(len(c.n))
        for _, b, _, _, _, _, v, s, _, _ in _steps(p, c, *_states(part, "enters", p.d)):
            total[b] -= 0.5 * (math.log(2 * math.pi) + np.log(s) + v * v / s)
        return pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("channel")), pa.array(total)], ["channel", "loglik"])

    rows = _mapped(entered(cut(obs, plan, q, r, size), plan, fan), p, body, "channel string, loglik double")
    return rows.groupBy("channel").agg(F.sum("loglik").alias("loglik"))


def _kept(plan: Matrices, c: Chunks, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """am, ap, h v / s, h h' / s and the matrices G that take a state's error on, of every step."""
    n, w, d = len(c.n), c.y.shape[1], plan.d
    am, score, ap, info, g = np.zeros((n, w, d)), np.zeros((n, w, d)), *(np.zeros((n, w, d, d)) for _ in range(3))
    for k, b, a, cov, h, gain, v, s, _, _ in _steps(plan, c, *_states(part, "enters", d)):
        am[b, k], ap[b, k] = a, cov
        score[b, k] = h * (v / s)[:, None]
        info[b, k] = h[:, :, None] * h[:, None, :] / s[:, None, None]
        g[b, k] = plan.f @ (np.eye(d) - gain[:, :, None] * h[:, None, :])
    return am, ap, score, info, g


def _back(c: Chunks, score: np.ndarray, info: np.ndarray, g: np.ndarray, u: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
    """(step, which chunks, u, N) from the last step to the first."""
    u, n = u.copy(), n.copy()
    for k in reversed(range(c.y.shape[1])):
        b = np.flatnonzero(c.there[:, k])
        gt = g[b, k].transpose(0, 2, 1)
        u[b] = np.einsum("bij,bj->bi", gt, u[b]) + score[b, k]
        n[b] = gt @ n[b] @ g[b, k] + info[b, k]
        yield k, b, u[b], n[b]


def smoothed(obs: DataFrame, plan: Plan, q: dict[str, Column | float], r: Column | float, size: int = SIZE, fan: int = FAN) -> DataFrame:
    """(channel, t, m, v): smoothed means and variances, as ``state_space.backward``, a row a step."""
    p = Matrices(plan)
    rows = entered(cut(obs, plan, q, r, size), plan, fan)

    def element(part: pa.RecordBatch, c: Chunks) -> pa.RecordBatch:
        _, _, score, info, g = _kept(p, c, part)
        size = (len(c.n), p.d)
        phi, u, n = np.broadcast_to(np.eye(p.d), (*size, p.d)).copy(), np.zeros(size), np.zeros((*size, p.d))
        for k, b, ub, nb in _back(c, score, info, g, u, n):
            u[b], n[b] = ub, nb
            phi[b] = phi[b] @ g[b, k]
        e = np.concatenate([phi.reshape(len(c.n), -1), u, n.reshape(len(c.n), -1)], 1)
        return pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("channel")), part.column(part.schema.get_field_index("at")), _lists(e)], ["channel", "at", "e"])

    elements = _mapped(rows.withColumn("at", -F.col("chunk")), p, element, "channel string, at long, e array<double>")
    state = prefix(elements, [0.0] * (p.d**2 + p.d), backward_combine, backward_act, p.d, fan)
    rows = rows.join(state.select("channel", (-F.col("at")).alias("chunk"), F.col("state").alias("after")), ["channel", "chunk"])

    def body(part: pa.RecordBatch, c: Chunks) -> pa.RecordBatch:
        am, ap, score, info, g = _kept(p, c, part)
        m, v = np.empty_like(am), np.empty_like(am)
        for k, b, u, n in _back(c, score, info, g, *_states(part, "after", p.d)):
            m[b, k] = am[b, k] + np.einsum("bij,bj->bi", ap[b, k], u)
            v[b, k] = np.einsum("bii->bi", ap[b, k]) - np.einsum("bij,bjk,bki->bi", ap[b, k], n, ap[b, k])
        return pa.RecordBatch.from_arrays([_named(part, c), pa.array(c.t, pa.int32()), _lists(m[c.there]), _lists(v[c.there])], ["channel", "t", "m", "v"])

    return _mapped(rows, p, body, "channel string, t int, m array<double>, v array<double>")
