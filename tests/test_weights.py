"""Pareto fits of weights, gammas of any shape, and plans without unreachable states."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_core import observations
from tideline.functions import random
from tideline.operators import pareto, predictive
from tideline.operators import state_space as ss
from tideline.plans import model as plans


def brute_fit(w):
    """Zhang and Stephens's fit to the largest weights, in NumPy."""
    w = np.sort(np.asarray(w))
    m = math.ceil(min(len(w) / 5, 3 * math.sqrt(len(w))))
    x = w[-m:] - w[-m - 1]
    if m < 5 or x[0] == x[-1] or x[int(m / 4 + 0.5) - 1] <= 0:
        return None, None, m
    j = np.arange(1, 30 + int(math.sqrt(m)) + 1)
    theta = 1 / x[-1] + (1 - np.sqrt(len(j) / (j - 0.5))) / (3 * x[int(m / 4 + 0.5) - 1])
    k = np.log1p(-theta[:, None] * x).mean(axis=1)
    like = m * (np.log(-theta / k) - k - 1)
    e = np.exp(like - like.max())
    t = (theta * e).sum() / e.sum()
    k = np.log1p(-t * x).mean()
    return (m * k + 5) / (m + 10), -k / t, m


def test_pareto(spark):
    g = np.random.default_rng(3)
    data = {"light": g.uniform(size=500), "heavy": g.pareto(1.0, size=2000), "exp": g.exponential(size=900), "few": g.uniform(size=12), "same": np.ones(200), "zero": np.zeros(50)}
    rows = [(c, i, float(v)) for c, w in data.items() for i, v in enumerate(w)]
    df = spark.createDataFrame(rows, "channel string, point int, weight double").repartition(4)
    got = {r["channel"]: r for r in pareto.fit(df).collect()}
    assert got.keys() == data.keys()
    for c, w in data.items():
        shape, scale, m = brute_fit(w)
        assert got[c]["m"] == m and got[c]["shape"] == (None if shape is None else pytest.approx(shape, abs=1e-9)) and got[c]["scale"] == (None if scale is None else pytest.approx(scale, rel=1e-9))
    assert got["light"]["shape"] < 0.3 < pareto.TRUST < got["heavy"]["shape"] and got["few"]["shape"] is None
    even = {(r["channel"], r["point"]): r["weight"] for r in pareto.smoothed(df).collect()}
    assert len(even) == len(rows)
    for c in ("heavy", "few"):
        w = data[c] / data[c].sum() if c == "few" else data[c]
        mine = np.array([even[c, i] for i in range(len(w))])
        assert mine.sum() == pytest.approx(1)
        if c == "few":
            assert mine == pytest.approx(w)
        else:
            assert mine.max() / mine.min() <= w.max() / w.min() * (1 + 1e-9) and np.array_equal(np.argsort(np.argsort(mine)), np.argsort(np.argsort(w)))
    with pytest.warns(UserWarning, match="2 channels|1 channels"):
        pareto.warn(pareto.fit(df))
    assert pareto.fit(df.limit(0)).count() == 0


@pytest.mark.parametrize("shape", [0.3, 1.0, 1.7, 20.0])
def test_gamma_of_any_shape(spark, shape):
    n = 20_000
    x = np.sort([r[0] for r in spark.range(n).select(random.gamma(shape, 5, F.col("id"))).collect()])
    assert x[0] > 0 and x.mean() == pytest.approx(shape, abs=4 * math.sqrt(shape / n)) and x.var() == pytest.approx(shape, rel=0.1)
    third = ((x - x.mean()) ** 3).mean() / x.std() ** 3
    assert third == pytest.approx(2 / math.sqrt(shape), rel=0.25)


def test_prior_draws_of_any_shape(spark):
    m = plans.Model(priors=plans.Priors(variance=plans.InverseGamma(3.7, 2.0)))
    v = np.array([r["params"]["variance"] for r in predictive.prior_draws(spark, m, 8000).collect()])
    assert v.mean() == pytest.approx(2.0 / 2.7, rel=0.04) and (1 / v).mean() == pytest.approx(3.7 / 2.0, rel=0.03)
    with pytest.raises(ValueError):
        random.gamma(0.0, 1, F.lit(1))


def test_states_that_stay_zero_go(spark):
    y = [0.3, -1.0, 2.0, 0.4, 0.1, 1.5]
    still = plans.Priors(initial_slope=plans.Fixed(0.0), level=plans.Normal(0, 0.5))
    cases = {
        "slope": (plans.Model(components=(plans.LocalLinearTrend(trend_mode="static"),), priors=still), ("level",)),
        "slope that starts": (plans.Model(components=(plans.LocalLinearTrend(trend_mode="static"),), priors=plans.Priors(initial_slope=plans.Fixed(0.1))), ("level", "slope")),
        "moved through F": (plans.Model(components=(plans.LocalLinearTrend(level_mode="static"),), priors=plans.Priors(initial_level=plans.Fixed(0.0), initial_slope=plans.Fixed(0.0))), ("level", "slope")),
        "season": (plans.Model(components=(plans.LocalLevel(), plans.DummySeasonal(4, "static")), priors=plans.Priors(initial_seasonal=plans.Fixed(0.0))), ("level",)),
        "coefficient": (plans.Model(components=(plans.LocalLevel(), plans.Regression(("a", "b"), "static", coefficient=plans.Fixed(0.0)), plans.Regression(("c",), name="more"))), ("level", "more.c")),
        "nothing": (plans.Model(components=(plans.LocalLevel("static"),), priors=plans.Priors(initial_level=plans.Fixed(0.0))), ("level",)),
    }
    for name, (model, states) in cases.items():
        plan, whole = plans.compile_model(model), plans.compile_model(model, prune=False)
        assert plan.names == states and plan.outputs.keys() == whole.outputs.keys() and plan.features == whole.features, name
        obs = observations(spark, {"u": y})
        if plan.features:
            obs = obs.withColumn("x", F.array(*(F.sin(F.col("t") + i) for i in range(len(plan.features)))))
        s = ss.series(obs, ["channel"], x="x" if plan.features else None)
        q = {g: F.lit(0.3) for g in plan.noise}
        out = s.select(ss.likelihood(plan, F.col("ys"), q, F.lit(0.7)).alias("a"), ss.likelihood(whole, F.col("ys"), q, F.lit(0.7)).alias("b")).first()
        assert out["a"] == pytest.approx(out["b"], abs=1e-12), name
    assert plans.placeholder_features(cases["coefficient"][0], 2) == [[0.0] * 3] * 2 and plans.placeholder_features(cases["slope"][0], 2) == []


def brute_ess(chains):
    """Geyer's monotone sequence over split chains of scores, with all lags."""
    halves = np.array([h for c in chains for h in (c[: len(c) // 2], c[len(c) - len(c) // 2 :])])
    k, n = halves.shape
    c = halves - halves.mean(axis=1, keepdims=True)
    a = np.array([(c[:, : n - t] * c[:, t:]).sum(axis=1).mean() / n for t in range(n)])
    within = a[0] * n / (n - 1)
    plus = within * (n - 1) / n + halves.mean(axis=1).var(ddof=1)
    rho = 1 - (within - a) / plus
    rho[0] = 1
    total, last = 0.0, math.inf
    for i in range(n // 2):
        p = rho[2 * i] + rho[2 * i + 1]
        if p <= 0:
            break
        last = min(last, p)
        total += last
    return min(k * n, k * n / (2 * total - 1))


def test_effective_sizes_by_groups_of_lags(spark, monkeypatch):
    from statistics import NormalDist

    from tideline.operators import diagnostics

    g = np.random.default_rng(8)
    series = {}
    for name, phi in (("white", 0.0), ("slow", 0.97), ("against", -0.6)):
        e = g.normal(size=(4, 401))
        for t in range(1, 401):
            e[:, t] += phi * e[:, t - 1]
        series[name] = e
    rows = [(c, i, t, float(v)) for c, e in series.items() for i, x in enumerate(e) for t, v in enumerate(x)]
    df = spark.createDataFrame(rows, "channel string, chain int, draw int, value double")
    monkeypatch.setattr(diagnostics, "LAGS", 4)  # the slow ones take many groups
    got = {r["channel"]: r["ess"] for r in diagnostics.ess_bulk(df, ["channel"]).collect()}
    for c, e in series.items():
        halves = np.concatenate([[x[:200], x[201:]] for x in e])
        order = np.argsort(np.argsort(halves.ravel())) + 1
        z = np.array([NormalDist().inv_cdf((r - 0.375) / (order.size + 0.25)) for r in order]).reshape(halves.shape)
        assert got[c] == pytest.approx(brute_ess(np.concatenate(z.reshape(4, 2, 200), axis=0).reshape(4, 400)), rel=1e-6), c
    assert got["slow"] < 200 < 1000 < got["white"]


def test_effective_size_of_a_million_draws(spark):
    from tideline.operators import diagnostics

    x = spark.range(1_000_000).select(F.lit("a").alias("channel"), (F.col("id") % 4).cast("int").alias("chain"), F.floor(F.col("id") / 4).cast("int").alias("draw"), random.gaussian(3, F.col("id")).alias("value"))
    assert diagnostics.ess_bulk(x, ["channel"]).first()["ess"] > 900_000


def test_loess_of_windows(spark):
    from tideline.operators import plotdata

    g = np.random.default_rng(6)
    t = np.sort(g.choice(400, 150, replace=False)).tolist()
    rows = [("a", i, float(np.sin(i / 40) + g.normal() / 5)) for i in t] + [("b", 1, 2.0), ("b", 5, 3.0), ("c", 7, 1.5)]
    got = {(r["channel"], r["t"]): r["smooth"] for r in plotdata.loess(spark.createDataFrame(rows, "channel string, t int, y double").repartition(3), 0.3).collect()}
    assert len(got) == len(rows)
    for c in "abc":
        x, y = (np.array(v, float) for v in zip(*((r[1], r[2]) for r in rows if r[0] == c)))
        k = min(max(math.ceil(0.3 * len(x)), 3), len(x))
        for at in x:
            d = np.abs(x - at)
            h = np.sort(d)[k - 1]
            w = (1 - np.minimum(d / (h or 1), 1) ** 3) ** 3
            s = [(w * v).sum() for v in (np.ones_like(x), x - at, y, (x - at) ** 2, (x - at) * y)]
            det = s[0] * s[3] - s[1] ** 2
            want = (s[3] * s[2] - s[1] * s[4]) / det if det > 1e-12 * s[0] ** 2 else s[2] / s[0]
            assert got[c, int(at)] == pytest.approx(want, abs=1e-9)
