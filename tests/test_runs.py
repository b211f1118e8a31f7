"""Runs on record: resumed, refused, broken off between tables, and combined from chains."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import runs

CONFIG = {
    "name": "t", "data": {"frequency": "seasonal", "series": ["Am", "Bm"]}, "model": {"period": 4, "steps_per_year": 4, "slope": "static", "seasonal": "static"},
    "priors": {"level_sd": 0.3}, "pooling": "private", "forecast_years": 1, "seed": 7, "risk_thresholds": {"Am": {"threshold": 1.0, "tail": "upper", "month": 1}},
    "profiles": {"smoke": {"draws": 6, "chains": 2, "points": 60, "predictive_draws": 20, "check_draws": 4, "max_blocks": 20}},
}


@pytest.fixture(scope="module")
def obs(spark):
    g = np.random.default_rng(2)
    rows = [(c, t, datetime(2000, 2, 28) + timedelta(days=91 * t), float(v)) for c in ("Am", "Bm", "Cm") for t, v in enumerate(np.cumsum(g.normal(size=24) * 0.3) + g.normal(size=24))]
    return spark.createDataFrame(rows, "channel string, t int, ts timestamp_ntz, y double")


@pytest.fixture(scope="module")
def whole(spark, obs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run") / "all")
    return path, runs.run(spark, CONFIG, obs, path, "smoke")


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def test_tables(whole):
    path, got = whole
    assert set(got) == {"observations", "posterior", "draws", "outputs", "effective", "posterior_summary", "posterior_checks", "residual_association", "forecasts", "risks"}
    assert got["observations"].count() == 40 and got["draws"].count() == 24 and got["forecasts"].count() == 8
    assert all(0 <= r["p_value"] <= 1 and 0 < r["distance"] < 1 for r in got["posterior_checks"].collect())
    assert all(r["lower"] <= r["mean"] <= r["upper"] and 0 <= r["mean"] <= 1 for r in got["risks"].collect()) and got["risks"].count() == 4
    assert {r["parameter"] for r in got["posterior_summary"].collect()} >= {"Am.level", "Bm.variance", "Am.location[t=20]"}
    corr = {(r[0], r[1]): r[2] for r in got["residual_association"].collect()}
    assert corr["Am", "Am"] == pytest.approx(1) and corr["Am", "Bm"] == pytest.approx(corr["Bm", "Am"])


def test_resumed_and_refused(spark, obs, whole, monkeypatch):
    path, got = whole
    before = rows(got["draws"].drop("params", "states"), "channel", "chain", "draw")
    monkeypatch.setattr(runs, "fits_of", lambda *a: pytest.fail("a finished run is computed again"))
    again = runs.run(spark, CONFIG, obs, path, "smoke")
    assert rows(again["draws"].drop("params", "states"), "channel", "chain", "draw") == before
    for other in (CONFIG | {"seed": 8}, CONFIG | {"priors": {"level_sd": 0.2}}):
        with pytest.raises(ValueError, match="another run"):
            runs.run(spark, other, obs, path, "smoke")
    with pytest.raises(ValueError, match="another run"):
        runs.run(spark, CONFIG, obs.withColumn("y", F.col("y") + 1), path, "smoke")
    for wrong in ({"channel": "Cm"}, {"chain": 2}):
        with pytest.raises(ValueError):
            runs.run(spark, CONFIG, obs, path + "-x", "smoke", **wrong)
    with pytest.raises(ValueError, match="all channels"):
        runs.run(spark, CONFIG | {"pooling": "shared"}, obs, path + "-x", "smoke", channel="Am")


def test_broken_off_between_tables(spark, obs, whole, tmp_path, monkeypatch):
    path, got = str(tmp_path / "broken"), whole[1]
    done, step = [], runs.step

    def failing(spark, at, make):
        if at.endswith("/posterior_checks") and "posterior_checks" not in done:
            done.append("posterior_checks")
            raise RuntimeError("lost")
        return step(spark, at, make)

    monkeypatch.setattr(runs, "step", failing)
    with pytest.raises(RuntimeError):
        runs.run(spark, CONFIG, obs, path, "smoke")
    assert runs.read_text(spark, f"{path}/manifest") is None
    with pytest.raises(ValueError, match="another run"):
        runs.run(spark, CONFIG | {"seed": 9}, obs, path, "smoke")
    with pytest.raises(ValueError, match="finished"):
        runs.combine(spark, [path], str(tmp_path / "c"))
    monkeypatch.setattr(runs, "fits_of", lambda *a: pytest.fail("the fit was there"))
    end = runs.run(spark, CONFIG, obs, path, "smoke")
    assert rows(end["forecasts"], "channel", "t") == rows(got["forecasts"], "channel", "t")
    assert json.loads(runs.read_text(spark, f"{path}/manifest"))["tables"] == sorted(got)


def test_chains_combine_to_the_run_of_all(spark, obs, whole, tmp_path):
    got = whole[1]
    parts = [str(tmp_path / f"chain{i}") for i in range(2)]
    for i, p in enumerate(parts):
        assert {r["chain"] for r in runs.run(spark, CONFIG, obs, p, "smoke", chain=i)["draws"].collect()} == {i}
    one = runs.combine(spark, parts, str(tmp_path / "both"))
    key = ("channel", "chain", "draw")
    assert [(r["channel"], r["chain"], r["draw"], r["params"], r["states"]) for r in one["draws"].orderBy(*key).collect()] == [(r["channel"], r["chain"], r["draw"], r["params"], r["states"]) for r in got["draws"].orderBy(*key).collect()]
    assert rows(one["forecasts"], "channel", "t") == rows(got["forecasts"], "channel", "t")
    assert rows(runs.combine(spark, parts, str(tmp_path / "both"))["risks"], "channel", "t") == rows(got["risks"], "channel", "t")
    with pytest.raises(ValueError, match="twice"):
        runs.combine(spark, [parts[0], parts[0]], str(tmp_path / "no"))
    runs.run(spark, CONFIG, obs.withColumn("y", F.col("y") + 1), str(tmp_path / "moved"), "smoke", chain=1)
    with pytest.raises(ValueError, match="another model"):
        runs.combine(spark, [parts[0], str(tmp_path / "moved")], str(tmp_path / "no"))
    with pytest.raises(ValueError):
        runs.combine(spark, [], str(tmp_path / "no"))


def test_analyses():
    base = CONFIG | {"model": CONFIG["model"] | {"seasonal_scale": True}, "pooling": "shared"}
    got = {n: runs.analysis(base, n) for n in runs.ANALYSES}
    assert len(got) == 5 and got["main"]["model"]["seasonal_scale"] and not got["constant_dispersion"]["model"]["seasonal_scale"]
    assert got["monthly"]["model"]["period"] == 12 and got["private"]["pooling"] == "private"
    with pytest.raises(ValueError):
        runs.analysis(base, "other")
