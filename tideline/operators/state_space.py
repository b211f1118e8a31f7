"""Linear state-space filters and smoothers as folds inside Catalyst.

A channel's series is one array; a filter is ``aggregate`` over it, with the small
matrices of a compiled plan written out as expressions (zeros drop out).  So a
table of channels, or of channels by parameter values, is filtered by a projection:
no shuffle beyond the one that makes the arrays, no Python, and channels in parallel.

x_t = F x_{t-1} + sum_g sqrt(q_g) R_g e_t,  y_t = H_t x_t + e_t,  var e_t = r_t,
from x_0 ~ N(m, C).  Smoothing runs backwards without inverting a matrix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.plans.model import Plan


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def series(obs: DataFrame, keys: list[str], t: str = "t", y: str = "y", x: str | None = None) -> DataFrame:
    """(keys, ys): each series as array<struct<t, y[, x]>> in the order of t."""
    fields = [F.col(t).alias("t"), F.col(y).cast("double").alias("y")] + ([F.col(x).alias("x")] if x else [])
    return obs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("ys"))


def _dot(coefficients, vector: list[Column]) -> Column | None:
    out = None
    for c, v in zip(coefficients, vector):
        if isinstance(c, float) and c == 0.0:
            continue
        term = v if isinstance(c, float) and c == 1.0 else -v if isinstance(c, float) and c == -1.0 else v * c
        out = term if out is None else out + term
    return out


def _or0(x: Column | None) -> Column:
    return F.lit(0.0) if x is None else x


def _loading(plan: Plan, y: Column) -> list:
    names = list(plan.features)
    return [F.get(y["x"], names.index(h)) if isinstance(h, str) else h for h in plan.loading]


def _noise(plan: Plan, q: dict[str, Column], i: int, j: int) -> Column | None:
    out = None
    for g, cols in plan.noise.items():
        c = sum(r[i] * r[j] for r in cols)
        if c:
            out = q[g] * c if out is None else out + q[g] * c
    return out


def _predict(plan: Plan, q: dict[str, Column], m: Column, p: Column) -> tuple[Column, Column]:
    d = len(plan.names)
    f = plan.transition
    mean = F.array(*(_or0(_dot(f[i], [m[j] for j in range(d)])) for i in range(d)))
    half = F.array(*(_or0(_dot(f[i], [p[k * d + j] for k in range(d)])) for i in range(d) for j in range(d)))

    def whole(a: Column) -> Column:
        cells = []
        for i in range(d):
            for j in range(d):
                x, n = _dot(f[j], [a[i * d + k] for k in range(d)]), _noise(plan, q, i, j)
                cells.append(_or0(x if n is None else n if x is None else x + n))
        return F.array(*cells)

    return mean, let(half, whole)


def forward(plan: Plan, ys: Column, q: dict[str, Column], r: Callable[[Column], Column] | Column) -> Column:
    """array<struct<t, m, p, am, ap, v, s>>: at each t the filtered state m, p, and what was predicted before
    seeing y: am, ap, the error v and its variance s.  ``q``: variances by noise group; ``r``: variance
    of the observation, or a function of the series' entry."""
    q = {g: c.cast("double") for g, c in q.items()}
    r_of = r if callable(r) and not isinstance(r, Column) else lambda y: r
    kind = "array<struct<t:int,m:array<double>,p:array<double>,am:array<double>,ap:array<double>,v:double,s:double>>"
    start = F.struct(
        F.array(*map(F.lit, plan.mean)).alias("m"), F.array(*(F.lit(x) for row in plan.cov for x in row)).alias("p"), F.array().cast(kind).alias("out")
    )

    def kept(acc: Column, y: Column, a: Column, b: Column, s: Column, z: Column) -> Column:
        row = F.struct(y["t"].cast("int").alias("t"), z["m"].alias("m"), z["p"].alias("p"), a["am"].alias("am"), a["ap"].alias("ap"), b["v"].alias("v"), s.alias("s"))
        return F.struct(z["m"].alias("m"), z["p"].alias("p"), F.concat(acc["out"], F.array(row)).alias("out"))

    return F.aggregate(ys, start, lambda acc, y: _advance(plan, q, r_of, acc, y, kept))["out"]


def _advance(plan: Plan, q: dict[str, Column], r_of: Callable, acc: Column, y: Column, made: Callable) -> Column:
    """One step of a filter: ``made`` is given the state before, the entry, what was predicted (am, ap), the error
    (v, ph), its variance and the state after (m, p)."""
    d = len(plan.names)
    am, ap = _predict(plan, q, acc["m"], acc["p"])

    def seen(a: Column) -> Column:
        h = _loading(plan, y)
        m, p = a["am"], a["ap"]
        ph = [_or0(_dot(h, [p[i * d + j] for j in range(d)])) for i in range(d)]
        return let(
            F.struct((y["y"] - _or0(_dot(h, [m[i] for i in range(d)]))).alias("v"), F.array(*ph).alias("ph")),
            lambda b: let(
                _or0(_dot(h, [b["ph"][i] for i in range(d)])) + r_of(y),
                lambda s: let(
                    F.struct(
                        F.array(*(m[i] + b["ph"][i] * b["v"] / s for i in range(d))).alias("m"),
                        F.array(*(p[i * d + j] - b["ph"][i] * b["ph"][j] / s for i in range(d) for j in range(d))).alias("p"),
                    ),
                    lambda z: made(acc, y, a, b, s, z),
                ),
            ),
        )

    return let(F.struct(am.alias("am"), ap.alias("ap")), seen)


def loglik(path: Column) -> Column:
    """Log likelihood of a series from its forward path."""
    return F.aggregate(path, F.lit(0.0), lambda a, x: a - 0.5 * (math.log(2 * math.pi) + F.log(x["s"]) + x["v"] * x["v"] / x["s"]))


def likelihood(plan: Plan, ys: Column, q: dict[str, Column], r: Callable[[Column], Column] | Column) -> Column:
    """Log likelihood alone: the fold carries one state and a sum, so a long series costs its length."""
    q = {g: c.cast("double") for g, c in q.items()}
    r_of = r if callable(r) and not isinstance(r, Column) else lambda y: r
    start = F.struct(F.array(*map(F.lit, plan.mean)).alias("m"), F.array(*(F.lit(x) for row in plan.cov for x in row)).alias("p"), F.lit(0.0).alias("sum"))

    def summed(acc: Column, y: Column, a: Column, b: Column, s: Column, z: Column) -> Column:
        term = 0.5 * (math.log(2 * math.pi) + F.log(s) + b["v"] * b["v"] / s)
        return F.struct(z["m"].alias("m"), z["p"].alias("p"), (acc["sum"] - term).alias("sum"))

    return F.aggregate(ys, start, lambda acc, y: _advance(plan, q, r_of, acc, y, summed))["sum"]


def backward(plan: Plan, ys: Column, path: Column) -> Column:
    """array<struct<t, m, v>>: smoothed state means and variances (the diagonal), in the order of t.

    With u, N from the end on:  u' = H v / s + L' u,  N' = H H'/s + L' N L,  L = F - F K H;
    the smoothed mean is am + ap u', the covariance ap - ap N' ap."""
    d = len(plan.names)
    f = plan.transition
    rng = range(d)
    kind = "array<struct<t:int,m:array<double>,v:array<double>>>"
    start = F.struct(F.array(*[F.lit(0.0)] * d).alias("u"), F.array(*[F.lit(0.0)] * (d * d)).alias("n"), F.array().cast(kind).alias("out"))

    def step(acc: Column, e: Column) -> Column:
        x, y = e["path"], e["ys"]
        h = [c if isinstance(c, Column) else F.lit(c) for c in _loading(plan, y)]
        # what the next step's values mean for this step: through F
        fu = F.array(*(_or0(_dot([f[k][i] for k in rng], [acc["u"][k] for k in rng])) for i in rng))
        nf = F.array(*(_or0(_dot([f[k][j] for k in rng], [acc["n"][i * d + k] for k in rng])) for i in rng for j in rng))
        gain = F.array(*(_or0(_dot(h, [x["ap"][i * d + j] for j in rng])) / x["s"] for i in rng))

        def through(b: Column) -> Column:
            fnf = F.array(*(_or0(_dot([f[k][i] for k in rng], [b["nf"][k * d + j] for k in rng])) for i in rng for j in rng))
            ku = sum((b["gain"][i] * b["fu"][i] for i in rng), F.lit(0.0))
            u = F.array(*(h[i] * (x["v"] / x["s"] - ku) + b["fu"][i] for i in rng))

            def both(c: Column) -> Column:
                kn = [sum((b["gain"][k] * c["m"][k * d + j] for k in rng), F.lit(0.0)) for j in rng]
                return let(
                    F.struct(F.array(*kn).alias("kn")),
                    lambda w: let(
                        sum((w["kn"][j] * b["gain"][j] for j in rng), F.lit(0.0)),
                        lambda knk: let(
                            F.struct(c["u"].alias("u"), F.array(*(h[i] * h[j] * (1 / x["s"] + knk) - h[i] * w["kn"][j] - w["kn"][i] * h[j] + c["m"][i * d + j] for i in rng for j in rng)).alias("n")),
                            lambda z: F.struct(
                                z["u"].alias("u"), z["n"].alias("n"),
                                F.concat(
                                    F.array(F.struct(
                                        x["t"].alias("t"),
                                        F.array(*(x["am"][i] + sum((x["ap"][i * d + j] * z["u"][j] for j in rng), F.lit(0.0)) for i in rng)).alias("m"),
                                        F.array(*(x["ap"][i * d + i] - sum((x["ap"][i * d + j] * z["n"][j * d + k] * x["ap"][k * d + i] for j in rng for k in rng), F.lit(0.0)) for i in rng)).alias("v"),
                                    )), acc["out"],
                                ).alias("out"),
                            ),
                        ),
                    ),
                )

            return let(F.struct(u.alias("u"), fnf.alias("m")), both)

        return let(F.struct(fu.alias("fu"), nf.alias("nf"), gain.alias("gain")), through)

    back = F.reverse(F.arrays_zip(path.alias("path"), ys.alias("ys")))
    return F.aggregate(back, start, step)["out"]


def output(plan: Plan, name: str, m: Column) -> Column:
    """A named output, or ``location``, of a state."""
    load = plan.loading if name == "location" else plan.outputs[name]
    if any(isinstance(h, str) for h in load):
        raise ValueError("a location with features needs the features: use location_of")
    return _or0(_dot(load, [m[i] for i in range(len(load))]))


def location_of(plan: Plan, m: Column, y: Column) -> Column:
    """The location of a state, with the features of a series' entry."""
    return _or0(_dot(_loading(plan, y), [m[i] for i in range(len(plan.names))]))
