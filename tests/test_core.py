"""The time-series operators against NumPy, closed forms and invariants."""

import json
import math
from statistics import NormalDist

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.functions import gev, normal, random, scale
from tideline.operators import blocks, diagnostics, experiments, plotdata, posterior, predictive, summaries
from tideline.operators import state_space as ss
from tideline.plans import model as plans
from tideline.sources import daily, storage
from tideline.streaming import level


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def observations(spark, series, x=None):
    rows = [(c, t, float(y), *([[float(v) for v in x[t]]] if x is not None else [])) for c, ys in series.items() for t, y in enumerate(ys)]
    return frame(spark, rows, "channel string, t int, y double" + (", x array<double>" if x is not None else ""))


# ---- families


def test_normal_functions(spark):
    xs = [-37.5, -20.0, -8.0, -3.0, -0.5, 0.0, 0.5, 3.0, 8.0]
    df = frame(spark, [(x,) for x in xs], "x double")
    d = NormalDist()
    for r in df.select("x", normal.cdf0(F.col("x")).alias("p"), normal.sf(F.col("x"), F.lit(0.0), F.lit(1.0)).alias("q"), normal.logpdf(F.col("x"), F.lit(1.0), F.lit(2.0)).alias("l")).collect():
        assert r["p"] == pytest.approx(math.erfc(-r["x"] / math.sqrt(2)) / 2, rel=1e-6 if abs(r["x"]) > 7 else 1e-12, abs=1e-300)
        assert r["q"] == pytest.approx(math.erfc(r["x"] / math.sqrt(2)) / 2, rel=1e-6 if abs(r["x"]) > 7 else 1e-12, abs=1e-300)
        assert r["l"] == pytest.approx(math.log(NormalDist(1, 2).pdf(r["x"])) if r["x"] > -30 else r["l"])
    ps = [1e-300, 1e-20, 1e-9, 1e-3, 0.1, 0.5, 0.7, 0.999, 1 - 1e-12]
    for r in frame(spark, [(p,) for p in ps], "p double").select("p", normal.ppf0(F.col("p")).alias("z")).collect():
        assert math.erfc(-r["z"] / math.sqrt(2)) / 2 == pytest.approx(r["p"], rel=1e-10)
        if 1e-9 <= r["p"] <= 0.999:
            assert r["z"] == pytest.approx(d.inv_cdf(r["p"]), abs=1e-9)
    bad = spark.range(1).select(normal.ppf0(F.lit(0.0)).alias("a"), normal.ppf0(F.lit(1.0)).alias("b"), normal.cdf(F.lit(0.0), F.lit(0.0), F.lit(-1.0)).alias("c")).first()
    assert bad["a"] == -math.inf and bad["b"] == math.inf and math.isnan(bad["c"])


def test_gev_functions(spark):
    rows = [(y, e, s, x) for y, e, s in ((-0.2, 0.1, 0.8), (0.5, 0.2, 1.1), (1.4, 0.3, 1.3)) for x in (0.0, 1e-9, -1e-9, 0.15, -0.2)]
    df = frame(spark, rows, "y double, e double, s double, x double")
    h = 1e-4
    for tail in ("upper", "lower"):
        at = lambda y, f, tail=tail: f(y, F.col("e"), F.col("s"), F.col("x"), tail)
        move = lambda d, f, tail=tail: f(F.col("y"), F.col("e") + d, F.col("s"), F.col("x"), tail)
        got = df.select(
            "*", at(F.col("y"), gev.cdf).alias("cdf"), at(F.col("y"), gev.sf).alias("sf"), at(F.col("y"), gev.gradient).alias("g"), at(F.col("y"), gev.hessian).alias("h"), ((move(h, gev.logpdf) - move(-h, gev.logpdf)) / (2 * h)).alias("dg"),
            ((move(h, gev.gradient) - move(-h, gev.gradient)) / (2 * h)).alias("dh"), ((at(F.col("y") + h, gev.cdf) - at(F.col("y") - h, gev.cdf)) / (2 * h)).alias("pdf"), F.exp(at(F.col("y"), gev.logpdf)).alias("p"),
            *(at(gev.ppf(F.lit(p), F.col("e"), F.col("s"), F.col("x"), tail), gev.cdf).alias(f"r{i}") for i, p in enumerate((0.1, 0.5, 0.9))),
        )
        for r in got.collect():
            assert r["cdf"] + r["sf"] == pytest.approx(1, abs=1e-12) and r["g"] == pytest.approx(r["dg"], abs=1e-6) and r["h"] == pytest.approx(r["dh"], abs=1e-6)
            assert r["pdf"] == pytest.approx(r["p"], abs=1e-6) and [r[f"r{i}"] for i in range(3)] == pytest.approx([0.1, 0.5, 0.9], abs=1e-12)
    out = spark.range(1).select(
        gev.logpdf(F.lit(100.0), F.lit(0.0), F.lit(1.0), F.lit(-0.5)).alias("l"), gev.cdf(F.lit(100.0), F.lit(0.0), F.lit(1.0), F.lit(-0.5)).alias("c"), gev.sf(F.lit(-100.0), F.lit(0.0), F.lit(1.0), F.lit(0.5)).alias("s"),
        gev.gradient(F.lit(100.0), F.lit(0.0), F.lit(1.0), F.lit(-0.5)).alias("g"), gev.cdf(F.lit(-1.3), F.lit(0.2), F.lit(1.0), F.lit(0.1), "lower").alias("a"), gev.sf(F.lit(1.3), F.lit(-0.2), F.lit(1.0), F.lit(0.1)).alias("b"),
    ).first()
    assert out["l"] == -math.inf and out["c"] == 1 and out["s"] == 1 and math.isnan(out["g"]) and out["a"] == pytest.approx(out["b"])
    with pytest.raises(ValueError):
        gev.cdf(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), "middle")


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 14))
def test_contrasts(period):
    c = np.array(scale.contrasts(period))
    assert np.allclose(c.T @ c, np.eye(period - 1)) and np.allclose(c.sum(axis=0), 0)


def test_noise_depends_on_its_keys_only(spark):
    a = spark.range(0, 20000, 1, 3).select("id", random.gaussian(7, F.col("id"), F.lit("x")).alias("z"), random.uniform(7, F.col("id")).alias("u"), random.gamma_integer(3, 7, F.col("id")).alias("g"))
    b = spark.range(0, 20000, 1, 9).select("id", random.gaussian(7, F.col("id"), F.lit("x")).alias("w"))
    assert a.join(b, "id").where("z <> w").count() == 0
    m = a.agg(F.avg("z"), F.var_samp("z"), F.avg("u"), F.min("u"), F.max("u"), F.avg("g"), F.var_samp("g")).first()
    assert abs(m[0]) < 0.03 and abs(m[1] - 1) < 0.05 and abs(m[2] - 0.5) < 0.01 and 0 < m[3] < m[4] < 1 and abs(m[5] - 3) < 0.06 and abs(m[6] - 3) < 0.2


# ---- sources and blocks


def test_blocks(spark):
    days = spark.sql("SELECT explode(sequence(DATE'1999-11-15', DATE'2001-12-20')) AS day").select("day", (F.dayofyear("day") * 1.0).alias("tx"), F.lit(-1.0).alias("tn"))
    assert daily.completeness(days, ("tx", "tn")).first()["complete"]
    season = blocks.require_blocks(days, "seasonal", ("tx", "tn")).orderBy("block_end").collect()
    assert [str(r["block_end"]) for r in season] == ["2000-02-29", "2000-05-31", "2000-08-31", "2000-11-30", "2001-02-28", "2001-05-31", "2001-08-31", "2001-11-30"]
    assert season[0]["tx_max"] == 365.0 and season[0]["tx_min"] == 1.0
    assert blocks.summaries(days, "monthly", ("tx",)).count() == 24
    gap = days.where("day <> DATE'2000-07-04'")
    assert not daily.completeness(gap, ("tx", "tn")).first()["complete"]
    with pytest.raises(ValueError):
        daily.require_complete(gap, ("tx", "tn"))
    with pytest.raises(ValueError):
        blocks.require_blocks(gap, "seasonal", ("tx",))
    with pytest.raises(ValueError):
        daily.require_complete(days.withColumn("tx", F.when(F.dayofmonth("day") == 3, float("nan")).otherwise(1.0)), ("tx",))
    obs = blocks.number(blocks.summaries(days, "seasonal", ("tx",)).select(F.lit("a").alias("channel"), F.col("block_end").cast("timestamp_ntz").alias("ts")), "ts", ["channel"])
    r = blocks.regularity(obs).first()
    assert r["regular"] and r["month_step"] == 3
    assert not blocks.regularity(obs.where("t <> 3")).first()["regular"]
    ts = predictive.future_calendar(obs, 3, month_step=3).orderBy("t").collect()
    assert [str(x["ts"])[:10] for x in ts] == ["2002-02-28", "2002-05-31", "2002-08-31"] and [x["t"] for x in ts] == [8, 9, 10]
    assert [x["l"] for x in obs.orderBy("t").select(blocks.phase_label(F.col("ts"), "seasonal").alias("l")).collect()] == ["DJF", "MAM", "JJA", "SON"] * 2


def test_csv_round_trip(spark, tmp_path):
    df = frame(spark, [("2000-01-01", 1.5, -2.0, "x"), ("2000-01-02", 2.5, -1.0, None)], "DAY string, TX double, TN double, RR string")
    daily.write_csv(df, str(tmp_path / "d"))
    got = daily.read_csv(spark, str(tmp_path / "d")).orderBy("day").collect()
    assert [(str(r["day"]), r["TX"], r["TN"]) for r in got] == [("2000-01-01", 1.5, -2.0), ("2000-01-02", 2.5, -1.0)]


def test_alignment(spark):
    obs = observations(spark, {"a": [1, 2, 3]})
    exog = frame(spark, [(0, 5.0, 1.0), (1, 6.0, 2.0), (2, 7.0, 3.0)], "t int, wind double, pressure double")
    assert [r["x"] for r in blocks.align(obs, exog, ["pressure", "wind"]).orderBy("t").collect()] == [[1.0, 5.0], [2.0, 6.0], [3.0, 7.0]]
    assert blocks.unaligned(obs, exog, ["wind"]).count() == 0
    assert [r["t"] for r in blocks.unaligned(obs, exog.where("t < 2"), ["wind"]).collect()] == [2]


# ---- models


def test_models_are_checked():
    for bad in (lambda: plans.Normal(0, -1), lambda: plans.Normal(float("nan"), 1), lambda: plans.InverseGamma(0, 1), lambda: plans.Priors(level=plans.Normal(1, 1)), lambda: plans.Priors(variance=plans.Fixed(0)), lambda: plans.Pooling(), lambda: plans.GEV("middle"), lambda: plans.Model(parameters={"mean": 1}),
                lambda: plans.Model(parameters={"shape": plans.Constant(plans.Normal())}), lambda: plans.compile_model(plans.Model(components=(plans.LocalLevel("off"),))), lambda: plans.compile_model(plans.Model(components=(plans.LocalLevel(), plans.LocalLevel()))),
                lambda: plans.MultiSeriesModel({"a/b": plans.Model()}), lambda: plans.MultiSeriesModel({"a": plans.Model(components=(plans.LocalLevel("static"),))}, plans.Pooling(level=plans.HalfNormal(1)))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        plans.Model(parameters={"location": plans.Latent((plans.LocalLevel(),), "log")})
    m = plans.Model(parameters={"location": plans.Constant(plans.Normal(3, 2)), "scale": plans.Fixed(2.0)})
    assert m.priors.variance == plans.Fixed(4.0) and m.priors.initial_level == plans.Normal(3, 2) and not m.active()
    full = plans.Model(components=(plans.LocalLinearTrend(), plans.DummySeasonal(4), plans.Cycle(8), plans.Regression(("wind",), "dynamic")))
    assert full.active() == {"level", "slope", "seasonal", "cycle", "regression.wind"} and full.period == 4
    fixed = plans.compile_model(plans.Model(components=(plans.LocalLevel(),), priors=plans.Priors(level=plans.Fixed(0.0))))
    assert fixed.noise == {}


def test_seasonal_start_is_a_zero_sum_cycle():
    b = plans.DummySeasonal(4).build(plans.Priors(initial_seasonal=plans.Normal(0, 2)))
    f, c = np.array(b.transition), np.array(b.cov)
    first = f @ c @ f.T  # phases 0, 3, 2 at the first observation
    want = 4 * (np.eye(4) - 0.25)
    assert np.allclose(first, want[np.ix_([0, 3, 2], [0, 3, 2])])
    assert np.allclose(np.linalg.matrix_power(f, 4), np.eye(3))


# ---- filters


def dense(plan, q, r, y, hs):
    """Smoothed state means and covariances by conditioning one big normal vector."""
    f, d, n = np.array(plan.transition), len(plan.names), len(y)
    noise = sum((q[g] * sum(np.outer(c, c) for c in map(np.array, cols)) for g, cols in plan.noise.items()), np.zeros((d, d)))
    big_m, cov = [np.array(plan.mean)], [[None] * (n + 1) for _ in range(n + 1)]
    cov[0][0] = np.array(plan.cov)
    for t in range(1, n + 1):
        big_m.append(f @ big_m[-1])
        for k in range(t):
            cov[t][k] = f @ cov[t - 1][k]
            cov[k][t] = cov[t][k].T
        cov[t][t] = f @ cov[t - 1][t - 1] @ f.T + noise
    s = np.block([[cov[i][j] for j in range(1, n + 1)] for i in range(1, n + 1)])
    h = np.zeros((n, n * d))
    for t in range(n):
        h[t, t * d : (t + 1) * d] = hs[t]
    m = np.concatenate(big_m[1:])
    g = h @ s @ h.T + np.diag(r if np.ndim(r) else np.full(n, r))
    k = s @ h.T @ np.linalg.inv(g)
    e = np.asarray(y) - h @ m
    ll = -0.5 * (n * math.log(2 * math.pi) + np.linalg.slogdet(g)[1] + e @ np.linalg.solve(g, e))
    return (m + k @ e).reshape(n, d), np.diag(s - k @ h @ s).reshape(n, d), ll


@pytest.mark.parametrize("parts", [(plans.LocalLevel(),), (plans.LocalLinearTrend(),), (plans.DummySeasonal(4),), (plans.LocalLevel("static"), plans.Cycle(5, 0.9)), (plans.LocalLevel(), plans.Regression(("w",), "dynamic"))])
def test_filter_and_smoother_equal_dense_conditioning(spark, parts):
    m = plans.Model(components=parts, priors=plans.Priors(initial_level=plans.Normal(0.5, 2.0), initial_slope=plans.Normal(0.1, 0.5)))
    plan = plans.compile_model(m)
    y, w = [1.0, -0.2, 0.7, 1.8, 2.5, 0.3], [1.0, 2.0, -0.5, 1.5, 0.2, -1.0]
    q = {g: 0.16 + 0.1 * i for i, g in enumerate(plan.noise)}
    hs = [[wt if isinstance(c, str) else c for c in plan.loading] for wt in w]
    mean, var, ll = dense(plan, q, 0.5, y, hs)
    obs = observations(spark, {"a": y}, [[v] for v in w])
    x = ss.series(obs, ["channel"], x="x").withColumn("path", ss.forward(plan, F.col("ys"), {g: F.lit(v) for g, v in q.items()}, F.lit(0.5)))
    r = x.select(ss.loglik(F.col("path")).alias("ll"), ss.backward(plan, F.col("ys"), F.col("path")).alias("s"), "path").first()
    assert r["ll"] == pytest.approx(ll, abs=1e-10)
    assert np.allclose([s["m"] for s in r["s"]], mean, atol=1e-10) and np.allclose([s["v"] for s in r["s"]], var, atol=1e-10)
    assert np.allclose(r["path"][-1]["m"], mean[-1], atol=1e-10)


def test_static_posteriors(spark):
    y = [1.0, 2.0, 1.5, 0.5, 3.0, 2.0]
    r = posterior.static_level(observations(spark, {"a": y}), plans.Normal(0, 2), 1.0).first()
    v = 1 / (6 + 0.25)
    assert r["variance"] == pytest.approx(v) and r["mean"] == pytest.approx(v * 10)
    g = np.random.default_rng(12)
    x = np.column_stack([np.ones(50), g.normal(size=(50, 2))])
    y = x @ [1, 1.2, -0.7] + g.normal(size=50) * 0.4
    got = posterior.static_regression(observations(spark, {"a": y}, x), 3, plans.Normal(0, 10), 0.16).orderBy("coefficient").collect()
    p = x.T @ x / 0.16 + np.eye(3) / 100
    assert np.allclose([r["mean"] for r in got], np.linalg.solve(p, x.T @ y / 0.16)) and np.allclose([r["sd"] for r in got], np.sqrt(np.diag(np.linalg.inv(p))))


def test_path_draws_have_the_smoothed_moments(spark):
    m = plans.Model(components=(plans.LocalLevel(),), priors=plans.Priors(initial_level=plans.Normal(0, 2)))
    plan = plans.compile_model(m)
    y = [1.0, -0.2, 0.7, 1.8]
    mean, var, _ = dense(plan, {"level": 0.16}, 0.5, y, [[1.0]] * 4)
    obs = observations(spark, {"a": y})
    weights = frame(spark, [("a", 0, {"level": 0.4, "variance": 0.5}, 1.0)], "channel string, point int, params map<string,double>, weight double")
    draws = posterior.path_draws(obs, posterior.take(weights, 4000), m)
    assert draws.count() == 4000
    got = posterior.outputs(draws, m).where("component = 'level'").groupBy("t").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).orderBy("t").collect()
    assert np.allclose([r["m"] for r in got], mean[:, 0], atol=0.04) and np.allclose([r["v"] for r in got], var[:, 0], atol=0.025)
    with_two = posterior.combine(draws, draws)
    assert with_two.select("chain").distinct().count() == 8
    with pytest.raises(ValueError):
        posterior.combine(draws, draws.where("draw < 10"))


def test_grid_posterior_and_pooling(spark):
    g = np.random.default_rng(3)
    ys = {c: np.cumsum(g.normal(size=30) * 0.3) + g.normal(size=30) * 0.5 for c in "ab"}
    obs = observations(spark, ys)
    m = plans.Model(components=(plans.LocalLevel(),), priors=plans.Priors(level=plans.Normal(0, 0.5), variance=plans.InverseGamma(2, 0.5)))
    grid = posterior.scale_grid(m, 4)
    got = posterior.grid_posterior(obs, m, grid).collect()
    assert len(got) == 32
    plan = plans.compile_model(m)
    for r in got[::7]:
        p = grid[r["point"]]
        assert r["loglik"] == pytest.approx(dense(plan, {"level": p["level"] ** 2}, p["variance"], ys[r["channel"]], [[1.0]] * 30)[2], abs=1e-8)
    for c in "ab":
        own = {r["point"]: r for r in got if r["channel"] == c}
        w = np.array([own[i]["loglik"] + grid[i]["log_prior"] for i in range(16)])
        w = np.exp(w - w.max())
        assert np.allclose([own[i]["weight"] for i in range(16)], w / w.sum())
    pooled = {(r["channel"], r["point"]): r["weight"] for r in posterior.grid_posterior(obs, m, grid, pooled=True).collect()}
    both = np.array([sum(r["loglik"] for r in got if r["point"] == i) + grid[i]["log_prior"] for i in range(16)])
    both = np.exp(both - both.max())
    assert np.allclose([pooled["a", i] for i in range(16)], both / both.sum()) and all(pooled["a", i] == pytest.approx(pooled["b", i]) for i in range(16))
    taken = posterior.take(posterior.grid_posterior(obs, m, grid), 1000)
    n = {(r["channel"], r["point"]): r["count"] for r in taken.groupBy("channel", "point").count().collect()}
    assert all(abs(n.get((r["channel"], r["point"]), 0) - 1000 * r["weight"]) <= 1.01 for r in got) and sum(n.values()) == 2000


def test_gev_posterior_equals_quadrature(spark):
    y = [-0.4, 0.2, 1.5, 0.7, -0.1, 1.2, 0.3, 0.6]
    eta = np.linspace(-1, 1.5, 51)
    got = posterior.gev_posterior(observations(spark, {"a": y}), "upper", eta.tolist(), [0.0], [-0.15], plans.Normal(0, 10)).select("weight", F.col("params")["eta"].alias("eta")).collect()
    z = np.subtract.outer(np.array(y), eta).T
    t = 1 - 0.15 * z
    ll = np.where(t > 0, (1 - 0.15) * np.log(np.maximum(t, 1e-300)) / 0.15 - np.maximum(t, 1e-300) ** (1 / 0.15), -np.inf).sum(axis=1) - 0.5 * (eta / 10) ** 2
    w = np.exp(ll - ll.max())
    assert sum(r["weight"] * r["eta"] for r in got) == pytest.approx((w * eta).sum() / w.sum(), abs=1e-9)


def test_gev_path_mode_is_stationary(spark):
    g = np.random.default_rng(5)
    y = 5 + np.cumsum(g.normal(size=25) * 0.2) - np.log(-np.log(g.uniform(size=25)))
    m = plans.Model(plans.GEV(), (plans.LocalLevel(),), plans.Priors(initial_level=plans.Normal(0, 10)))
    eta = np.array([e["eta"] for e in posterior.gev_path_mode(observations(spark, {"a": y}), m, {"level": 0.3, "sigma": 1.0, "xi": 0.0}, 12).first()["path"]])
    grad = np.array([1 - math.exp(-(a - b)) for a, b in zip(y, eta)])
    prec = np.zeros((25, 25))
    for t in range(1, 25):
        prec[t, t] += 1 / 0.09
        prec[t - 1, t - 1] += 1 / 0.09
        prec[t, t - 1] -= 1 / 0.09
        prec[t - 1, t] -= 1 / 0.09
    prec[0, 0] += 1 / (100 + 0.09)
    free = np.array([math.exp(a - b) - 1 < 10 for a, b in zip(y, eta)])  # else the shift of the pseudo-observation is bounded
    assert free.sum() >= 20 and np.abs((grad - prec @ eta)[free]).max() < 1e-3


# ---- prediction


def test_forecast_variance(spark):
    m = plans.Model(components=(plans.LocalLinearTrend(),), priors=plans.Priors(variance=plans.Fixed(1.0)))
    n, h = 12000, 12
    draws = spark.range(n).select(F.lit("y").alias("channel"), F.lit(0).alias("chain"), F.col("id").cast("int").alias("draw"), F.expr("map('level', 0.5D, 'slope', 0.2D, 'variance', 1D)").alias("params"), F.expr("array(named_struct('t', 0, 'm', array(1D, 0.5D)))").alias("states"))
    taken = spark.range(n).select(F.col("id").cast("int").alias("pred"), F.lit(0).alias("chain"), F.col("id").cast("int").alias("draw"))
    pred = predictive.predict(draws, m, 30, h, taken).where("t = 41").agg(F.avg("location"), F.var_samp("location"), F.var_samp("y")).first()
    want = h * 0.25 + h * (h - 1) * (2 * h - 1) / 6 * 0.04
    assert pred[0] == pytest.approx(1 + h * 0.5, abs=0.15) and pred[1] == pytest.approx(want, rel=0.05) and pred[2] == pytest.approx(want + 1, rel=0.05)
    with pytest.raises(ValueError):
        predictive.predict(draws, m, 30, True, taken)


def test_prior_predictive(spark):
    multi = plans.MultiSeriesModel({"a": plans.Model(components=(plans.LocalLevel(),)), "b": plans.Model(plans.GEV("lower"), (plans.LocalLevel(),))}, plans.Pooling(level=plans.HalfNormal(0.3)))
    x = predictive.prior_draws(spark, multi, 4000)
    assert x.count() == 8000
    tau = x.select("channel", "draw", F.col("params")["tau.level"].alias("tau"))
    assert tau.groupBy("draw").agg(F.countDistinct("tau").alias("n")).where("n > 1").count() == 0
    s = x.where("channel = 'b'").agg(F.avg(F.col("params")["tau.level"]), F.var_samp(F.col("params")["xi"]), F.avg(1 / F.col("params")["variance"])).first()
    assert s[0] == pytest.approx(0.3 * math.sqrt(2 / math.pi), rel=0.05) and s[1] == pytest.approx(0.09, rel=0.1) and s[2] == pytest.approx(1.0, rel=0.05)
    one = predictive.simulate(spark, plans.Model(components=(plans.LocalLevel(), plans.DummySeasonal(4))), 9)
    assert [r["t"] for r in one.orderBy("t").collect()] == list(range(1, 10))


# ---- summaries and diagnostics


def test_window_risk_extremes_coverage(spark):
    rows = frame(spark, [("a", 0, 0, 0.1), ("a", 0, 1, 0.2), ("a", 1, 0, 1.0), ("a", 1, 1, 0.5), ("a", 2, 0, 0.0)], "channel string, draw int, t int, risk double")
    got = {r["draw"]: r["risk"] for r in summaries.window_risk(rows, ["draw"]).collect()}
    assert got[0] == pytest.approx(1 - 0.9 * 0.8) and got[1] == 1 and got[2] == 0
    with pytest.raises(ValueError):
        summaries.require_rows(rows.where("t > 9"), "window")
    e = summaries.block_extremes(rows.withColumnRenamed("risk", "y").where("draw < 2"), 2, ["draw"])
    assert {(r["draw"], r["largest"], r["smallest"]) for r in e.collect()} == {(0, 0.2, 0.1), (1, 1.0, 0.5)}
    with pytest.raises(ValueError):
        summaries.require_divisible(summaries.block_extremes(rows.withColumnRenamed("risk", "y"), 2, ["draw"]), 2)
    g = np.random.default_rng(1)
    y = g.normal(size=(200, 10))
    pred = frame(spark, [("a", d, t, float(y[d, t])) for d in range(200) for t in range(10)], "channel string, draw int, t int, y double")
    obs = frame(spark, [("a", t, float(t - 5)) for t in range(10)], "channel string, t int, y double")
    c = summaries.coverage(pred, obs, (0.9,)).first()
    lo, hi = np.quantile(y, [0.05, 0.95], axis=0)
    o = np.arange(10) - 5.0
    assert c["coverage"] == pytest.approx(((lo <= o) & (o <= hi)).mean()) and c["width"] == pytest.approx((hi - lo).mean()) and c["below"] == (o < lo).sum() and c["above"] == (o > hi).sum()
    assert summaries.unmatched(pred, obs).count() == 0 and summaries.unmatched(pred, obs.where("t > 0")).count() == 1
    for bad in (0.0, 1.0):
        with pytest.raises(ValueError):
            summaries.summarize(pred, ["t"], "y", bad)
    with pytest.raises(ValueError):
        summaries.return_level(1.0, "upper")


def test_rhat_and_ess(spark):
    g = np.random.default_rng(41)
    x = g.normal(size=(4, 1500))
    shifted = x.copy()
    shifted[0] += 3
    rows = [(k, c, d, float(v[c, d])) for k, v in (("noise", x), ("shifted", shifted), ("constant", np.ones((4, 20)))) for c in range(4) for d in range(v.shape[1])]
    df = frame(spark, rows, "parameter string, chain int, draw int, value double")
    r = {a["parameter"]: a["rhat"] for a in diagnostics.rhat(df, ["parameter"]).collect()}
    assert r["noise"] < 1.01 and r["shifted"] > 1.1 and math.isnan(r["constant"])
    e = {a["parameter"]: a["ess"] for a in diagnostics.ess_bulk(df, ["parameter"]).collect()}
    assert e["noise"] > 3500 and e["shifted"] < 100 and math.isnan(e["constant"])
    assert math.isnan(diagnostics.rhat(df.where("chain = 0 AND parameter = 'noise'"), ["parameter"]).first()["rhat"])


def test_plot_types_and_loess(spark):
    with pytest.raises(ValueError):
        plotdata.frame("nothing")
    with pytest.raises(ValueError):
        plotdata.register("acf")(lambda: None)
    line = observations(spark, {"a": [2.0 * t + 1 for t in range(12)]})
    assert all(r["smooth"] == pytest.approx(2 * r["t"] + 1) for r in plotdata.loess(line, 0.5).collect())
    d = plotdata.density(frame(spark, [("a", float(v)) for v in np.random.default_rng(2).normal(size=500)], "channel string, value double"), ["channel"]).orderBy("x").collect()
    xs, ps = np.array([r["x"] for r in d]), np.array([r["density"] for r in d])
    assert len(d) == 250 and 0.95 < ((ps[1:] + ps[:-1]) / 2 * np.diff(xs)).sum() < 1.01


def test_results_do_not_depend_on_partitions(spark):
    g = np.random.default_rng(9)
    rows = [(c, i % 4, i // 4, float(g.normal())) for c in "ab" for i in range(80)]
    df = frame(spark, rows, "channel string, chain int, draw int, value double")
    got = []
    for n, shuffle in ((1, "1"), (7, "13")):
        spark.conf.set("spark.sql.shuffle.partitions", shuffle)
        got.append(sorted((r["channel"], round(r["rhat"], 12)) for r in diagnostics.rhat(df.repartition(n), ["channel"]).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got[0] == got[1]


# ---- experiments, storage, streams


def test_configurations(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"name": "base", "data": {"series": ["TXm", "TNn", "TXx"], "frequency": "seasonal"}, "model": {"period": 4, "seasonal_scale": True}, "pooling": "shared"}))
    (tmp_path / "child.json").write_text(json.dumps({"extends": "base.json", "model": {"slope": "static"}}))
    (tmp_path / "loop.json").write_text(json.dumps({"extends": "loop.json"}))
    c = experiments.validate(experiments.read_config(tmp_path / "child.json"))
    m = experiments.build_model(c)
    assert [type(x.observation).__name__ for x in m.channels.values()] == ["Gaussian", "GEV", "GEV"] and m.channels["TNn"].observation.tail == "lower"
    assert set(m.pooling.scales) == {"level", "seasonal"}
    with pytest.raises(ValueError):
        experiments.read_config(tmp_path / "loop.json")
    for bad in ({"modle": {}}, {"model": {"perod": 4}}, {"data": {"frequency": "monthly"}, "model": {"period": 4}}):
        with pytest.raises(ValueError):
            experiments.validate(bad)
    grid = experiments.sensitivity_grid(c, {"wide": {"priors": {"level_sd": 0.2}}})
    assert set(grid) == {"base", "wide"} and grid["wide"]["model"] == grid["base"]["model"]
    with pytest.raises(ValueError):
        experiments.sensitivity_grid(c, {"a/b": {}})


def test_storage(spark, tmp_path):
    m = plans.MultiSeriesModel({"a": plans.Model(components=(plans.LocalLinearTrend(), plans.DummySeasonal(4)))})
    obs = observations(spark, {"a": [1, 2, 3.5]})
    assert storage.decode(json.loads(json.dumps(storage.encode(m)))) == m
    path = storage.save(str(tmp_path / "fit"), {"draws": obs}, m, obs, 4, seed=3)
    got = storage.load(spark, path)
    assert got["model"] == m and got["meta"] == {"seed": 3} and got["tables"]["draws"].count() == 3
    assert storage.fingerprint(m, obs.repartition(3), 4) == got["fingerprint"] != storage.fingerprint(m, obs.where("t < 2"), 4)
    with pytest.raises(TypeError):
        storage.encode(object())
    with pytest.raises(ValueError):
        storage.decode({"type": "Nothing", "fields": {}})
    obs.where("t = 0").write.mode("overwrite").parquet(path + "/observations")
    with pytest.raises(ValueError):
        storage.load(spark, path)


def test_streaming_level_filter(spark, tmp_path):
    source = tmp_path / "in"
    rows = [("a", t, float(t % 3)) for t in range(8)] + [("b", t, 2.0) for t in range(4)]
    df = frame(spark, rows, "channel string, t int, y double")
    df.where("t < 4").coalesce(1).write.mode("append").parquet(str(source))
    df.where("t >= 4").union(df.where("channel = 'a' AND t = 1")).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    q = level.level_filter(stream, 0.2, 1.0, 0.0, 10.0).writeStream.outputMode("append").format("memory").queryName("levels").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["channel"], r["t"]): r["level"] for r in spark.sql("SELECT * FROM levels").collect()}
    assert len(got) == 12
    for c in "ab":
        m, v = 0.0, 10.0
        for _, t, y in sorted(r for r in rows if r[0] == c):
            p = v + 0.2
            m, v = m + p / (p + 1) * (y - m), p / (p + 1)
            assert got[c, t] == pytest.approx(m)


def test_streaming_blocks(spark, tmp_path):
    df = spark.sql("SELECT CAST(TIMESTAMP'2024-01-01' + make_interval(0, 0, 0, 0, id * 7) AS TIMESTAMP_NTZ) AS ts, 'v' AS event_type, CAST(id AS DOUBLE) AS value FROM range(40)")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = level.windowed_extremes(stream, "1 day", "1 day").writeStream.outputMode("append").format("memory").queryName("blocks").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM blocks ORDER BY start").collect()
    assert got and got[0]["n"] == 4 and got[0]["largest"] == 3.0 and got[1]["smallest"] == 4.0
