"""Rolling origins with refits: against separate fits, and scores against plain Python."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import posterior, predictive, validation
from tideline.plans import model as plans

LEVEL = (plans.LocalLevel(),)
NORMAL = plans.Model(components=LEVEL, priors=plans.Priors(level=plans.Normal(0, 0.5)))
LOWEST = plans.Model(plans.GEV("lower"), LEVEL, plans.Priors(level=plans.Fixed(0.1), variance=plans.InverseGamma(2, 2)))
ORIGINS, HORIZON = [14, 19, 26], 6


@pytest.fixture(scope="module")
def fits(spark):
    g = np.random.default_rng(4)
    rows = [(c, t, datetime(2000, 1, 1) + timedelta(days=31 * t), float(v)) for c in ("a", "b@x", "n") for t, v in enumerate(np.cumsum(g.normal(size=30) * 0.3) + g.normal(size=30))]
    obs = spark.createDataFrame(rows, "channel string, t int, ts timestamp_ntz, y double").repartition(3).withColumn("origin", F.lit("clash"))
    models = {"a": NORMAL, "b@x": NORMAL, "n": LOWEST}
    got = validation.refits(obs, models, ORIGINS, HORIZON, draws=40, chains=2, points=80, predictive_draws=60)
    return rows, obs, models, got


def test_refits_equal_separate_fits(spark, fits):
    _, obs, models, got = fits
    by = {(r["channel"], r["point"]): (r["weight"], r["loglik"]) for r in got["posterior"].collect()}
    ahead = {(r["channel"], r["draw"], r["t"]): r["y"] for r in got["forecast"].collect()}
    assert len(ahead) == 3 * 3 * 60 * HORIZON
    taken = predictive.draw_index(spark, 60, 2, 20, 1011)
    for c, o in (("a", 19), ("b@x", 14), ("n", 26)):
        own = obs.where((F.col("channel") == c) & (F.col("t") <= o)).withColumn("channel", F.lit(f"{c}@{o}"))
        one = posterior.fit(own, models[c], 40, 2, points=80)
        weights = one["posterior"].collect()
        assert len(weights) == 80 and all((r["weight"], r["loglik"]) == pytest.approx(by[r["channel"], r["point"]], abs=1e-12) for r in weights)
        pred = predictive.predict(one["draws"], models[c], o + 1, HORIZON, taken, 1011).collect()
        assert len(pred) == 60 * HORIZON and all(r["y"] == pytest.approx(ahead[r["channel"], r["draw"], r["t"]], abs=1e-12) for r in pred)


def test_scores(fits):
    rows, _, _, got = fits
    seen = {(c, t): y for c, t, _, y in rows}
    ahead = {}
    for r in got["forecast"].collect():
        ahead.setdefault((r["channel"], r["t"]), []).append(r)
    by = {(r["channel"], r["origin"], r["level"]): r for r in validation.coverage(got, HORIZON, (0.5, 0.9)).collect()}
    assert len(by) == 18 and by["a", 26, 0.9]["available"] == 3 and by["a", 19, 0.9]["available"] == HORIZON == by["a", 19, 0.9]["requested"]
    for (c, o, level), r in by.items():
        times = [t for t in range(o + 1, o + HORIZON + 1) if (c, t) in seen]
        q = {t: np.quantile([x["y"] for x in ahead[f"{c}@{o}", t]], [(1 - level) / 2, (1 + level) / 2]) for t in times}
        assert r["coverage"] == pytest.approx(np.mean([q[t][0] <= seen[c, t] <= q[t][1] for t in times])) and r["width"] == pytest.approx(np.mean([b - a for a, b in q.values()]))
        assert r["mean_error"] == pytest.approx(np.mean([np.mean([x["y"] for x in ahead[f"{c}@{o}", t]]) - seen[c, t] for t in times])) and (r["first_t"], r["last_t"]) == (times[0], times[-1])
    windows = validation.coverage_by_window(got, 4, (0.9,)).collect()
    assert {(r["channel"], r["origin"], r["window"], r["n"]) for r in windows} == {(c, o, w, n) for c in ("a", "b@x", "n") for o in ORIGINS for w, n in ((1, 4 if o < 26 else 3), (2, 2)) if o < 26 or w == 1}


def test_counts_by_month(spark, fits):
    rows, _, models, got = fits
    spec = spark.createDataFrame([("a", 0.5, "upper", 11), ("a", 0.5, "upper", 12), ("n", -0.5, "lower", 11)], "channel string, threshold double, tail string, phase int")
    out = {(r["channel"], r["origin"], r["threshold"]): r for r in validation.threshold_counts(got, spec.where("NOT (channel = 'a' AND phase = 12)"), F.month("ts")).collect()}
    assert out
    month = {(c, t): ts.month for c, t, ts, _ in rows}
    seen = {(c, t): y for c, t, _, y in rows}
    for (c, o, h), r in out.items():
        times = [t for t in range(o + 1, o + HORIZON + 1) if month.get((c, t)) == 11]
        assert r["seasons"] == len(times)
        past = (lambda y: y > h) if c == "a" else (lambda y: y < h)
        assert r["observed"] == sum(past(seen[c, t]) for t in times)
        draws, risks = {}, {}
        for x in got["forecast"].where(F.col("channel") == f"{c}@{o}").where(F.col("t").isin(times)).collect():
            draws[x["draw"]] = draws.get(x["draw"], 0) + past(x["y"])
            if c == "a":
                p = 0.5 * math.erfc((h - x["location"]) / x["sigma"] / math.sqrt(2))
            else:
                z = 1 + x["xi"] * (x["location"] - h) / x["sigma"]
                p = -math.expm1(-(z ** (-1 / x["xi"]))) if z > 0 else float(x["xi"] > 0)
            risks[x["draw"]] = risks.get(x["draw"], 0) + p
        assert r["expected"] == pytest.approx(np.mean(list(risks.values())), abs=1e-9)
        assert r["p_at_least"] == pytest.approx(np.mean([n >= r["observed"] for n in draws.values()])) and r["p_at_most"] == pytest.approx(np.mean([n <= r["observed"] for n in draws.values()]))


def test_origins_that_cannot_be_judged(fits):
    _, obs, models, _ = fits
    for origins in ([1], [29], [], [40], ["2000-01-01"]):
        with pytest.raises(ValueError):
            validation.refits(obs, models, origins, HORIZON)
