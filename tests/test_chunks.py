"""Chunked filters, smoothers and likelihoods against the folds over whole series, and against a plain loop on a long one."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import chunks
from tideline.operators import state_space as ss
from tideline.plans.model import Cycle, DummySeasonal, LocalLevel, LocalLinearTrend, Model, Regression, compile_model

MODELS = {
    "level": Model(components=(LocalLevel(),)),
    "trend": Model(components=(LocalLinearTrend(), DummySeasonal(4))),
    "features": Model(components=(LocalLinearTrend(), Regression(("a", "b"), "dynamic"), Cycle(7.0, 0.9))),
    "still": Model(components=(LocalLevel("static"),)),
}


def observations(spark, n=61, seed=3):
    r = np.random.default_rng(seed)
    rows = [(c, t + 5, float(y), [float(v) for v in r.normal(size=2)], float(r.uniform(0.2, 2))) for c in ("u", "v", "w") for t, y in enumerate(np.cumsum(r.normal(size=n if c != "w" else 1)))]
    return spark.createDataFrame(rows, "channel string, t int, y double, x array<double>, noise double").repartition(5).withColumn("chunk", F.lit("clash")).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))


@pytest.mark.parametrize("name,size,fan", [("level", 8, 2), ("trend", 7, 64), ("features", 16, 2), ("still", 1000, 64)])
def test_chunks_equal_folds(spark, name, size, fan):
    obs, plan = observations(spark), compile_model(MODELS[name])
    q = {g: 0.1 * (i + 1) for i, g in enumerate(plan.noise)}
    series = obs.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct("t", "y", "x", "noise"))).alias("ys"))
    path = ss.forward(plan, F.col("ys"), {g: F.lit(v) for g, v in q.items()}, lambda y: y["noise"])
    x = series.withColumn("path", path).withColumn("smooth", ss.backward(plan, F.col("ys"), F.col("path"))).collect()
    forward = {(r["channel"], e["t"]): e for r in x for e in r["path"]}
    backward = {(r["channel"], e["t"]): e for r in x for e in r["smooth"]}
    got = chunks.filtered(obs, plan, q, F.col("noise"), size, fan).collect()
    assert len(got) == len(forward) == 123
    for r in got:
        for c in ("m", "p", "am", "ap", "v", "s"):
            assert np.allclose(r[c], forward[r["channel"], r["t"]][c], rtol=1e-9, atol=1e-9)
    got = chunks.smoothed(obs, plan, q, F.col("noise"), size, fan).collect()
    assert len(got) == 123
    for r in got:
        for c in ("m", "v"):
            assert np.allclose(r[c], backward[r["channel"], r["t"]][c], rtol=1e-9, atol=1e-9)
    want = {r["channel"]: sum(-0.5 * (math.log(2 * math.pi) + math.log(e["s"]) + e["v"] ** 2 / e["s"]) for e in r["path"]) for r in x}
    assert {r["channel"]: r["loglik"] for r in chunks.likelihood(obs, plan, q, F.col("noise"), size, fan).collect()} == pytest.approx(want, abs=1e-8)


def test_chunks_of_nothing(spark):
    obs, plan = observations(spark).limit(0), compile_model(MODELS["level"])
    assert chunks.filtered(obs, plan, {"level": 0.1}, 1.0).count() == chunks.smoothed(obs, plan, {"level": 0.1}, 1.0).count() == chunks.likelihood(obs, plan, {"level": 0.1}, 1.0).count() == 0


def test_a_million_steps_of_one_channel(spark):
    """A thousand chunks in a scan of two levels, against a loop over all steps."""
    n, q, r = 1_000_000, 0.01, 1.0
    obs = spark.range(n).select(F.lit("one").alias("channel"), F.col("id").cast("int").alias("t"), (F.sin(F.col("id") / 1000) * 3 + F.sin(F.col("id") * 1.7)).alias("y"))
    plan = compile_model(MODELS["level"])
    y = np.array(obs.orderBy("t").toArrow().column("y"))
    m, p, loglik = plan.mean[0], plan.cov[0][0], 0.0
    ms, ps, preds = np.empty(n), np.empty(n), np.empty(n)
    for t, v in enumerate(y.tolist()):
        p += q
        preds[t] = p
        s = p + r
        e = v - m
        loglik -= 0.5 * (math.log(2 * math.pi * s) + e * e / s)
        m, p = m + p / s * e, p - p * p / s
        ms[t], ps[t] = m, p
    back, var = ms.copy(), ps.copy()
    for t in range(n - 2, -1, -1):
        g = ps[t] / preds[t + 1]
        back[t] += g * (back[t + 1] - ms[t])
        var[t] += g * g * (var[t + 1] - preds[t + 1])
    got = chunks.filtered(obs, plan, {"level": q}, r).orderBy("t").select(F.col("m")[0].alias("m"), F.col("p")[0].alias("p")).toArrow()
    assert np.allclose(got.column("m"), ms, rtol=0, atol=1e-9) and np.allclose(got.column("p"), ps, rtol=0, atol=1e-9)
    got = chunks.smoothed(obs, plan, {"level": q}, r).orderBy("t").select(F.col("m")[0].alias("m"), F.col("v")[0].alias("v")).toArrow()
    assert np.allclose(got.column("m"), back, rtol=0, atol=1e-9) and np.allclose(got.column("v"), var, rtol=0, atol=1e-9)
    assert chunks.likelihood(obs, plan, {"level": q}, r).first()["loglik"] == pytest.approx(loglik, rel=1e-11)
