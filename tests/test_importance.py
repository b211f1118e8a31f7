"""Importance sampling against dense linear algebra and quadrature."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_core import dense, observations
from tideline.operators import importance, posterior, predictive
from tideline.plans import model as plans

LEVEL = (plans.LocalLevel(),)


def weighted(rows, f):
    w = np.array([r["weight"] for r in rows])
    v = np.array([f(r["params"]) for r in rows])
    mean = (w * v).sum()
    return mean, math.sqrt((w * (v - mean) ** 2).sum())


def test_points_follow_the_posterior_far_from_the_prior(spark):
    g = np.random.default_rng(11)
    y = {"a": g.normal(size=40) * 10, "b": np.cumsum(g.normal(size=40) * 0.3) + g.normal(size=40) * 0.5}
    m = plans.Model(components=LEVEL, priors=plans.Priors(level=plans.Normal(0, 0.5)))
    plan = plans.compile_model(m)
    weights = importance.posterior(observations(spark, y), m, 400).cache()
    rows = weights.collect()
    got = {r["channel"]: (r["points"], r["effective"]) for r in importance.effective(weights).collect()}
    assert got.keys() == y.keys() and all(n == 400 and 100 < e <= 400 for n, e in got.values())
    for c, (lo, hi) in {"a": (2.0, 7.0), "b": (-4.0, 2.0)}.items():
        amps, logs = np.exp(np.linspace(-9, 1.2, 50)), np.linspace(lo, hi, 40)
        w = np.array([[dense(plan, {"level": a * a}, math.exp(v), y[c], [[1.0]] * 40)[2] - 0.5 * (a / 0.5) ** 2 + math.log(a) - 2 * v - 2 * math.exp(-v) for v in logs] for a in amps])
        w = np.exp(w - w.max())
        w /= w.sum()
        for f, exact in ((lambda p: math.log(p["variance"]), logs[None, :] + 0 * amps[:, None]), (lambda p: p["level"], amps[:, None] + 0 * logs[None, :])):
            mean = (w * exact).sum()
            sd = math.sqrt((w * (exact - mean) ** 2).sum())
            got = weighted([r for r in rows if r["channel"] == c], f)
            assert got[0] == pytest.approx(mean, abs=0.2 * sd) and got[1] == pytest.approx(sd, rel=0.25)


def test_seasonal_scales_enter_the_likelihood(spark):
    y = [0.3, -1.0, 2.0, 0.4, 0.1, 1.5, -3.0, 0.2]
    m = plans.Model(plans.Gaussian(plans.SeasonalScale(2)), LEVEL, plans.Priors(level=plans.Fixed(0.4), variance=plans.Fixed(0.5)))
    rows = importance.posterior(observations(spark, {"a": y}), m, 60).collect()
    assert set(rows[0]["params"]) == {"level", "variance", "u1"}
    for r in rows[::13]:
        u = r["params"]["u1"]
        by_phase = [0.5 * math.exp(2 * u / math.sqrt(2)), 0.5 * math.exp(-2 * u / math.sqrt(2))]
        cov = np.array([[100 + 0.16 * (min(i, j) + 1) for j in range(8)] for i in range(8)]) + np.diag([by_phase[t % 2] for t in range(8)])
        exact = -0.5 * (8 * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + np.array(y) @ np.linalg.solve(cov, y))
        assert r["loglik"] == pytest.approx(exact, abs=1e-8)
    fit = posterior.fit(observations(spark, {"a": y}), m, draws=40, points=60)
    got = posterior.sigma(fit["draws"], m).join(fit["draws"].select("chain", "draw", F.col("params")["u1"].alias("u")), ["chain", "draw"]).collect()
    assert len(got) == 320 and all(r["sigma"] == pytest.approx(math.sqrt(0.5) * math.exp((1 if r["t"] % 2 == 0 else -1) * r["u"] / math.sqrt(2))) for r in got)
    ahead = predictive.predict(fit["draws"], m, 8, 4, predictive.draw_index(spark, 20, 4, 10)).collect()
    assert len(ahead) == 80 and len({round(r["sigma"], 9) for r in ahead if r["draw"] == 0}) == 2


@pytest.mark.parametrize("tail", ["upper", "lower"])
def test_extreme_values_around_a_level(spark, tail):
    y = np.array([-0.4, 0.2, 1.5, 0.7, -0.1, 1.2, 0.3, 0.6]) * (1 if tail == "upper" else -1)
    m = plans.Model(plans.GEV(tail), (plans.LocalLevel("static"),), plans.Priors(initial_level=plans.Normal(0, 2), variance=plans.Fixed(1.0), shape=plans.Normal(0.0, 0.1)))
    fit = posterior.fit(observations(spark, {"a": y.tolist()}), m, draws=3000, points=400)
    rows = fit["draws"].select(F.col("params")["xi"].alias("xi"), F.col("states")[0]["m"][0].alias("eta")).collect()
    assert len(rows) == 3000
    eta, xi = np.linspace(-3, 3, 241), np.linspace(-0.45, 0.45, 120)
    e, x = np.meshgrid(eta, xi, indexing="ij")
    lp = -0.5 * (e / 2) ** 2 - 0.5 * (x / 0.1) ** 2
    for v in y:
        t = 1 + x * (v - e) * (1 if tail == "upper" else -1)
        a = -np.log(np.maximum(t, 1e-300)) / x
        lp = lp + np.where(t > 0, (1 + x) * a - np.exp(np.minimum(a, 700)), -np.inf)
    w = np.exp(lp - lp.max())
    w /= w.sum()
    for got, exact in ((np.array([r["eta"] for r in rows]), e), (np.array([r["xi"] for r in rows]), x)):
        mean = (w * exact).sum()
        sd = math.sqrt((w * (exact - mean) ** 2).sum())
        assert got.mean() == pytest.approx(mean, abs=0.15 * sd) and got.std() == pytest.approx(sd, rel=0.15)


def test_shared_scales_keep_amplitudes_apart(spark):
    g = np.random.default_rng(3)
    y = {"a": np.cumsum(g.normal(size=25) * 0.6) + g.normal(size=25) * 0.5, "b": np.cumsum(g.normal(size=25) * 0.2) + g.normal(size=25) * 0.5}
    m = plans.Model(components=LEVEL, priors=plans.Priors(level=plans.Normal(0, 0.5), variance=plans.Fixed(0.25)))
    plan = plans.compile_model(m)
    fit = posterior.fit(observations(spark, y), m, draws=400, points=600, pooling=plans.Pooling(level=plans.HalfNormal(0.5)))
    tau = np.linspace(0.005, 2.5, 300)
    amps = np.exp(np.linspace(-9, 1.2, 200))
    step = np.gradient(amps)
    total, each = -0.5 * (tau / 0.5) ** 2, {}
    for c in y:
        ll = np.array([dense(plan, {"level": a * a}, 0.25, y[c], [[1.0]] * 25)[2] for a in amps])
        each[c] = np.exp(ll - ll.max())[None, :] * np.exp(-0.5 * (amps[None, :] / tau[:, None]) ** 2) / tau[:, None] * step[None, :]
        total = total + np.log(each[c].sum(axis=1))
    w = np.exp(total - total.max())
    w /= w.sum()
    shared = fit["shared"].collect()
    s = np.array([r["weight"] for r in shared])
    assert (s / s.sum() * np.array([r["tau"][0] for r in shared])).sum() == pytest.approx((w * tau).sum(), rel=0.05)
    draws = fit["draws"].select("channel", "chain", "draw", F.col("params")["level"].alias("a"), F.col("params")["tau.level"].alias("tau")).collect()
    assert len(draws) == 800
    assert len({(r["chain"], r["draw"], r["tau"]) for r in draws}) == 400
    mean = {}
    for c in y:
        mean[c] = (w * (each[c] * amps[None, :]).sum(axis=1) / each[c].sum(axis=1)).sum()
        assert np.mean([r["a"] for r in draws if r["channel"] == c]) == pytest.approx(mean[c], rel=0.12)
    assert mean["a"] > 1.3 * mean["b"]


def test_two_shared_scales_and_points_far_out(spark):
    points = [(0.5, 0.1, 0.5), (2.0, 0.3, 0.5), (1e4, 0.2, 0.0), (0.1, 1e200, 0.0)]
    own = spark.createDataFrame([(c, i, {"level": a, "slope": b, "variance": 1.0}, 0.0, w) for c in "ab" for i, (a, b, w) in enumerate(points)], "channel string, point int, params map<string,double>, loglik double, weight double")
    m = plans.Model(priors=plans.Priors(level=plans.Normal(0, 1.0), slope=plans.Normal(0, 0.2)))
    shared, taken = importance.pooled(own, m, plans.Pooling(level=plans.HalfNormal(1.0), slope=plans.HalfNormal(0.2)), 100)
    got = shared.collect()
    assert len(got) == 200 and all(0 <= r["weight"] <= 1 and all(t > 0 for t in r["tau"]) for r in got)

    def density(tau):
        each = sum(w * math.exp(-0.5 * (a * a * (1 / tau[0] ** 2 - 1) + b * b * (1 / tau[1] ** 2 - 25))) / (tau[0] * tau[1] / 0.2) for a, b, w in points if w)
        return 2 * math.log(each) if each > 0 else -math.inf

    exact = np.array([density(r["tau"]) for r in got])
    assert np.allclose([r["weight"] for r in got], np.exp(exact - exact.max()), atol=1e-9)
    rows = taken.select("channel", "chain", "draw", F.col("params")["level"].alias("a"), F.map_keys("params").alias("k")).collect()
    assert len(rows) == 200 and {r["a"] for r in rows} == {0.5, 2.0}
    assert set(rows[0]["k"]) == {"level", "slope", "variance", "tau.level", "tau.slope"}


def test_series_that_cannot_be_fitted(spark):
    good = [1.0, 2.0, 3.0, 4.0]
    importance.check(observations(spark, {"a": good}))
    for bad in ({"a": [1.0, 2.0]}, {"a": good, "b": [1.0, float("nan"), 2.0]}, {"a": [1.0, float("inf"), 2.0]}):
        with pytest.raises(ValueError):
            importance.check(observations(spark, bad))
    whole = observations(spark, {"a": good})
    for bad in (whole.where("t <> 2").union(whole.selectExpr("channel", "t + 9", "y")), whole.union(whole), whole.withColumn("y", F.when(F.col("t") != 1, F.col("y")))):
        with pytest.raises(ValueError):
            importance.check(bad)
    importance.check(whole.limit(0))
