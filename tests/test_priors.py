"""What priors imply for changes over years: spreads by closed forms, thresholds, roots of covariances."""

import math

import numpy as np
import pytest

from tideline.operators import experiments
from tideline.plans import model as plans


def test_roots():
    roots = experiments.horizon_roots([10, 30], 4)
    for g, cov in {"level": [[40, 40], [40, 120]], "seasonal": [[20, 20], [20, 60]], "slope": [[sum((h - r) * (k - r) for r in range(1, min(h, k))) for k in (40, 120)] for h in (40, 120)]}.items():
        r = np.array(roots[g])
        assert np.allclose(r @ r.T, cov)


def test_calibrate(spark):
    priors = plans.Priors(level=plans.Normal(0, 0.1), slope=plans.Normal(0, 0.002), seasonal=plans.Fixed(0.0), initial_slope=plans.Normal(0.0, 0.01))
    parts = (plans.LocalLinearTrend(), plans.DummySeasonal(4))
    still = plans.Model(components=(plans.LocalLevel("static"),))
    model = plans.MultiSeriesModel({"a": plans.Model(components=parts, priors=priors), "still": still})
    spec = spark.createDataFrame([("a", 0.0), ("still", -1.0)], "channel string, threshold double")
    got = {(r["channel"], r["years"], r["contribution"]): r for r in experiments.calibrate(spark, model, [10, 30], 4, 8000, thresholds=spec).collect()}
    assert len(got) == 2 * 2 * 5 and all(r["draws"] == 8000 for r in got.values())
    slope = lambda h: h * (h - 1) * (2 * h - 1) / 6 * 0.002**2
    for years in (10, 30):
        h = 4 * years
        want = {"level": h * 0.01, "slope": slope(h), "seasonal": 0.0, "initial_rate": (h * 0.01) ** 2}
        want["combined"] = sum(want.values())
        for c, v in want.items():
            r = got["a", years, c]
            assert r["sd"] == pytest.approx(math.sqrt(v), rel=0.06) and abs(r["mean"]) <= 4 * math.sqrt(v / 8000) + 1e-12 and r["lower_95"] <= r["mean"] <= r["upper_95"]
        assert got["a", years, "combined"]["share"] == pytest.approx(0.5, abs=0.03)
        assert got["still", years, "combined"]["sd"] == 0 and got["still", years, "combined"]["share"] == 1
