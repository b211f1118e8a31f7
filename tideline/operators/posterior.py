"""Posteriors as Spark jobs.

Instead of a Markov chain in one task, a posterior is computed where it can be
spread: conjugate posteriors from sums; scales and shapes of a dynamic model by
importance sampling whose points are rows, each filtered by a fold (``fit``), or on a
given grid; constant extreme-value parameters on a grid by a grouped sum of log densities.  Draws are then rows taken from those weights,
and state paths are drawn by smoothing the difference to a simulated series.  All
noise is hashed from (seed, channel, draw, time), so reruns agree.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import gev, random
from tideline.operators import importance, pareto
from tideline.operators.importance import take
from tideline.operators import state_space as ss
from tideline.plans.model import Fixed, HalfNormal, InverseGamma, Model, Normal, Pooling, compile_model
from tideline.sources.scratch import settle


def capability(model: Model) -> dict[str, str]:
    """How each part of a model is computed; raises NotImplementedError for what isn't."""
    family = model.observation.family
    if family not in ("gaussian", "gev"):
        raise NotImplementedError(f"observation family {family}")
    return {"path": "fold" if family == "gaussian" else "fold around the mode", "scales": "importance sampling", "shape": "importance sampling" if family == "gev" else "none", "draws": "systematic resampling and a simulation smoother"}


def static_level(obs: DataFrame, prior: Normal, variance: float) -> DataFrame:
    """(channel, n, mean, variance) of a constant level under a known observation variance."""
    n, total = F.count("y"), F.sum("y")
    v = 1 / (n / variance + 1 / prior.sd**2)
    return obs.groupBy("channel").agg(n.alias("n"), (v * (total / variance + prior.mean / prior.sd**2)).alias("mean"), v.alias("variance"))


def moments(obs: DataFrame, features: int) -> DataFrame:
    """(channel, n, yy, xy array, xx array): the sums a linear regression needs, one pass with
    partial sums in each task; x is ``x array<double>``."""
    x = [F.get("x", F.lit(i)) for i in range(features)]
    xx = [F.sum(x[i] * x[j]) for i in range(features) for j in range(features)]
    return obs.groupBy("channel").agg(F.count("y").alias("n"), F.sum(F.col("y") * F.col("y")).alias("yy"), F.array(*(F.sum(a * F.col("y")) for a in x)).alias("xy"), F.array(*xx).alias("xx"))


def static_regression(obs: DataFrame, features: int, prior: Normal, variance: float) -> DataFrame:
    """(channel, coefficient, mean, sd) of y = x . b under a known observation variance; x may hold
    a constant.  Up to three features are solved in an expression, step by step for more."""
    m = moments(obs, features)
    k = features
    cell = lambda i, j: F.col("xx")[i * k + j] / variance + (1 / prior.sd**2 if i == j else 0.0)
    x = m
    names = [[f"_a{i}_{j}" for j in range(2 * k + 1)] for i in range(k)]
    for i in range(k):
        row = [cell(i, j) for j in range(k)] + [F.lit(float(i == j)) for j in range(k)] + [F.col("xy")[i] / variance + prior.mean / prior.sd**2]
        x = x.withColumns(dict(zip(names[i], row)))
    for i in range(k):  # one projection for each pivot keeps expressions small
        x = x.withColumns({n: F.col(n) / F.col(names[i][i]) for n in names[i]})
        x = x.withColumns({names[r][c]: F.col(names[r][c]) - F.col(names[r][i]) * F.col(names[i][c]) for r in range(k) if r != i for c in range(2 * k + 1)})
    out = F.array(*(F.struct(F.lit(i).alias("coefficient"), F.col(names[i][2 * k]).alias("mean"), F.sqrt(F.col(names[i][k + i])).alias("sd")) for i in range(k)))
    return x.select("channel", F.explode(out).alias("o")).select("channel", "o.*")


def log_prior(p: object, value: float, group_scale: float | None = None) -> float:
    """Log density of a prior at a value, up to what doesn't depend on it."""
    if isinstance(p, Normal):
        sd = p.sd if group_scale is None else group_scale
        return -0.5 * ((value - p.mean) / sd) ** 2 - math.log(sd)
    if isinstance(p, HalfNormal):
        return -0.5 * (value / p.sd) ** 2
    if isinstance(p, InverseGamma):
        return -(p.shape + 1) * math.log(value) - p.scale / value
    return 0.0


def scale_grid(model: Model, points: int = 7, low: float = 0.05, high: float = 3.0, variances: tuple[float, ...] | None = None) -> list[dict]:
    """Grid points {group: amplitude, variance}: geometric from ``low`` to ``high`` prior scales, with log weights
    of prior and spacing."""
    plan = compile_model(model)
    geometric = lambda s: [s * low * (high / low) ** (i / (points - 1)) for i in range(points)]
    axes = {}
    for g, p in plan.amplitude.items():
        axes[g] = [p.value] if isinstance(p, Fixed) else geometric(p.sd)
    v = model.priors.variance
    axes["variance"] = [v.value] if isinstance(v, Fixed) else list(variances or geometric(v.scale))
    priors = plan.amplitude | {"variance": v}
    out = []
    for values in itertools.product(*axes.values()):
        point = dict(zip(axes, values))
        # on a geometric grid each point stands for a span in proportion to itself
        w = sum(log_prior(priors[g], x) + (math.log(x) if len(axes[g]) > 1 else 0.0) for g, x in point.items())
        out.append(point | {"log_prior": w})
    return out


def grid_posterior(obs: DataFrame, model: Model, grid: list[dict], pooled: bool = False) -> DataFrame:
    """(channel, point, params, loglik, weight): the posterior of the scales on a grid, for every channel;
    with ``pooled``, of amplitudes and a variance that are the same in all channels.

    Every (channel, point) is a row; the grid is a literal array that rows are exploded over."""
    if model.observation.family != "gaussian":
        raise NotImplementedError("a grid of scales takes normal observations; see gev_posterior")
    if model.observation.scale is not None:
        raise NotImplementedError("a grid of scales takes one observation variance, not a seasonal scale")
    plan = compile_model(model)
    if plan.features and "x" not in obs.columns:
        raise ValueError(f"the model needs features {plan.features} in a column x")
    names = [n for n in grid[0] if n != "log_prior"]
    entries = F.array(*(F.struct(F.lit(i).alias("point"), F.lit(float(p["log_prior"])).alias("log_prior"), *(F.lit(float(p[n])).alias(f"p_{n}") for n in names)) for i, p in enumerate(grid)))
    rows = ss.series(obs, ["channel"], x="x" if plan.features else None).withColumn("g", F.explode(entries))
    q = {g: F.col(f"g.p_{g}") * F.col(f"g.p_{g}") for g in plan.noise}
    rows = rows.select("channel", "g.point", "g.log_prior", F.create_map(*(x for n in names for x in (F.lit(n), F.col(f"g.p_{n}")))).alias("params"), ss.likelihood(plan, F.col("ys"), q, F.col("g.p_variance")).alias("loglik"))
    key = ["channel"]
    if pooled:
        shared = Window.partitionBy("point")
        rows = rows.withColumn("total", F.sum("loglik").over(shared))
    else:
        rows = rows.withColumn("total", F.col("loglik"))
    w = Window.partitionBy(*key)
    rows = rows.withColumn("e", F.exp(F.col("total") + F.col("log_prior") - F.max(F.col("total") + F.col("log_prior")).over(w)))
    return rows.select("channel", "point", "params", "loglik", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def path_draws(obs: DataFrame, taken: DataFrame, model: Model, seed: int = 1000) -> DataFrame:
    """(channel, chain, draw, params, states array<struct<t, m>>): a state path drawn for each parameter draw.

    A series is simulated from the model, and the smoothed difference to the data is
    added to the simulated states, which is an exact draw of a normal model.  For extreme values
    a column ``weight`` is added, by which paths have to be taken anew."""
    return path_draws_of(importance.gathered(obs, model), taken, model, seed)


def path_draws_of(series: DataFrame, taken: DataFrame, model: Model, seed: int = 1000) -> DataFrame:
    """``path_draws`` of series (channel, ys)."""
    plan = compile_model(model)
    d, groups = len(plan.names), list(plan.noise)
    x = "x" if plan.features else None
    family = model.observation.family
    value = lambda name: F.element_at("params", name)
    rows = importance.observed(taken.join(series, "channel"), model, value)
    key = [F.col("channel"), F.col("chain"), F.col("draw")]
    amp = {g: F.element_at("params", g) for g in groups}
    root = _root(plan.cov)
    noise = lambda t, i: random.gaussian(seed, *key, t, F.lit(i))
    first = F.array(*(F.lit(plan.mean[i]) + sum((noise(F.lit(-1), j) * root[i][j] for j in range(d) if root[i][j]), F.lit(0.0)) for i in range(d)))

    def step(acc: Column, y: Column) -> Column:
        m = acc["m"]
        t = y["t"].cast("int")
        move = []
        for i in range(d):
            v = ss._or0(ss._dot(plan.transition[i], [m[j] for j in range(d)]))
            k = 0
            for g in groups:
                for col in plan.noise[g]:
                    if col[i]:
                        v = v + amp[g] * noise(t, 100 + k) * col[i]
                    k += 1
            move.append(v)
        return ss.let(F.array(*move), lambda z: F.struct(z.alias("m"), F.concat(acc["out"], F.array(F.struct(t.alias("t"), z.alias("m"), (ss.location_of(plan, z, y) + F.sqrt(y["r"]) * noise(t, 99)).alias("y")))).alias("out")))

    start = F.struct(first.alias("m"), F.array().cast("array<struct<t:int,m:array<double>,y:double>>").alias("out"))
    rows = rows.withColumn("sim", F.aggregate("seen", start, step)["out"])
    fields = lambda y, s: F.struct(y["t"].alias("t"), (y["y"] - s["y"]).alias("y"), y["r"].alias("r"), *([y["x"].alias("x")] if x else []))
    rows = rows.withColumn("diff", F.zip_with("seen", "sim", fields))
    # the difference has mean zero at time zero
    centred = replace(plan, mean=(0.0,) * d)
    rows = rows.withColumn("path", ss.forward(centred, F.col("diff"), {g: a * a for g, a in amp.items()}, lambda y: y["r"]))
    rows = rows.withColumn("smooth", ss.backward(centred, F.col("diff"), F.col("path")))
    states = F.zip_with("sim", "smooth", lambda a, b: F.struct(a["t"].alias("t"), F.zip_with(a["m"], b["m"], lambda u, v: u + v).alias("m")))
    rows = rows.withColumn("states", states)
    if family == "gaussian":
        return rows.select("channel", "chain", "draw", "params", "states")
    location = F.zip_with("states", "ys", lambda s, y: ss.location_of(plan, s["m"], y))
    rows = rows.withColumn("lw", importance.gain(model, F.col("ys"), F.col("seen"), location, F.col("sig"), value("xi")) - F.col("offset"))
    w = Window.partitionBy("channel")
    rows = rows.select("channel", "chain", "draw", "params", "states", F.when(F.isnan("lw"), importance.IMPOSSIBLE).otherwise(F.col("lw")).alias("lw"))
    return rows.withColumn("weight", F.exp(F.col("lw") - F.max("lw").over(w))).drop("lw")


def _root(cov: tuple[tuple[float, ...], ...]) -> list[list[float]]:
    """A lower triangular square root of a positive semidefinite matrix."""
    d = len(cov)
    out = [[0.0] * d for _ in range(d)]
    for i in range(d):
        for j in range(i + 1):
            s = cov[i][j] - sum(out[i][k] * out[j][k] for k in range(j))
            if i == j:
                out[i][j] = math.sqrt(max(s, 0.0))
            elif out[j][j] > 1e-12:
                out[i][j] = s / out[j][j]
    return out


def outputs(draws: DataFrame, model: Model) -> DataFrame:
    """(channel, chain, draw, t, component, value): every named output and the location, in long form."""
    plan = compile_model(model)
    names = [*plan.outputs, "location"] if not plan.features else [n for n, h in plan.outputs.items() if not any(isinstance(x, str) for x in h)]
    long = draws.select("channel", "chain", "draw", F.explode("states").alias("s"))
    each = F.array(*(F.struct(F.lit(n).alias("component"), ss.output(plan, n, F.col("s.m")).alias("value")) for n in names))
    return long.select("channel", "chain", "draw", F.col("s.t").alias("t"), F.explode(each).alias("o")).select("channel", "chain", "draw", "t", "o.*")


def fit(obs: DataFrame, model: Model, draws: int = 1000, chains: int = 4, seed: int = 1000, points: int = 400, pooling: Pooling | None = None, spare: int = 3, only: tuple[int, ...] | None = None) -> dict[str, DataFrame]:
    """The whole way: {posterior, draws, outputs, effective[, shared]}, written to the shared folder as it is made, so no use
    of it starts from the data again.  With ``pooling`` amplitudes are each channel's own, under scales that all share
    (``shared``).  ``spare``: paths drawn for each one taken, for extreme values.  ``only``: chains to draw; they are
    the same as in a fit of all chains."""
    importance.check(obs)
    return fit_of(importance.gathered(obs, model), model, draws, chains, seed, points, pooling, spare, only)


def fit_of(series: DataFrame, model: Model, draws: int = 1000, chains: int = 4, seed: int = 1000, points: int = 400, pooling: Pooling | None = None, spare: int = 3, only: tuple[int, ...] | None = None) -> dict[str, DataFrame]:
    """``fit`` of series (channel, ys)."""
    capability(model)
    if draws < 1 or chains < 1 or draws % chains:
        raise ValueError("draws must be a multiple of chains")
    series = settle(series, "series")
    weights = settle(importance.posterior_of(series, model, points, seed=seed), "weights")
    gev_family = model.observation.family == "gev"
    many = draws * spare if gev_family else draws
    shared = None
    if pooling is None:
        taken = take(weights, many, chains)
    else:
        shared, taken = importance.pooled(weights, model, pooling, many, chains, seed)
        shared = settle(shared, "shared")
    if only is not None:
        taken = taken.where(F.col("chain").isin(*only))
    paths = settle(path_draws_of(series, taken, model, seed), "paths")
    worth = importance.effective(weights).join(pareto.shape(weights), "channel")
    if gev_family:
        # of these weights nobody sees more than this
        more = importance.effective(paths).join(pareto.shape(paths), "channel")
        worth = worth.join(more.select("channel", F.col("points").alias("paths"), F.col("effective").alias("effective_paths"), F.col("shape").alias("shape_paths")), "channel")
        numbered = paths.withColumnsRenamed({"chain": "own", "draw": "point"})
        paths = take(numbered, draws // chains, 1, keys=("channel", "own"))
        paths = settle(paths.select("channel", F.col("own").alias("chain"), "draw", "params", "states"), "draws")
    worth = settle(worth, "effective")
    pareto.warn(worth)
    out = {"posterior": weights, "draws": paths, "outputs": outputs(paths, model), "effective": worth}
    return out if shared is None else out | {"shared": shared}


def sigma(draws: DataFrame, model: Model) -> DataFrame:
    """(channel, chain, draw, t, sigma) of each draw at each time of its path."""
    by_phase = importance.sigmas(model, lambda name: F.element_at("params", name))
    x = draws.select("channel", "chain", "draw", by_phase.alias("sig"), F.explode(F.transform("states", lambda s: s["t"])).alias("t"))
    return x.select("channel", "chain", "draw", "t", importance.sigma_at(model, F.col("sig"), F.col("t")).alias("sigma"))


def gev_posterior(obs: DataFrame, tail: str, eta: list[float], log_sigma: list[float], xi: list[float], prior_eta: Normal = Normal(0.0, 10.0), variance: InverseGamma = InverseGamma(), shape: Normal = Normal(0.0, 0.3)) -> DataFrame:
    """(channel, point, params, loglik, weight) of a constant extreme-value distribution on a grid.

    Each observation is exploded over the literal grid and log densities are summed by
    (channel, point), with partial sums before the shuffle: rows times points of work,
    channels times points of shuffle.  -Infinity marks a point outside the support."""
    points = list(itertools.product(eta, log_sigma, xi))
    prior = [log_prior(prior_eta, e) + log_prior(shape, x) - 2 * variance.shape * s - variance.scale * math.exp(-2 * s) for e, s, x in points]
    entries = F.array(*(F.struct(F.lit(i).alias("point"), F.lit(e).alias("eta"), F.lit(math.exp(s)).alias("sigma"), F.lit(x).alias("xi"), F.lit(p).alias("log_prior")) for i, ((e, s, x), p) in enumerate(zip(points, prior))))
    x = obs.select("channel", "y", F.explode(entries).alias("g")).select("channel", "y", "g.*")
    total = F.sum(gev.logpdf(F.col("y"), F.col("eta"), F.col("sigma"), F.col("xi"), tail))
    x = x.groupBy("channel", "point", "eta", "sigma", "xi", "log_prior").agg(total.alias("loglik"))
    w = Window.partitionBy("channel")
    post = F.col("loglik") + F.col("log_prior")
    x = x.withColumn("e", F.exp(post - F.max(post).over(w)))
    params = F.create_map(F.lit("eta"), F.col("eta"), F.lit("sigma"), F.col("sigma"), F.lit("xi"), F.col("xi"))
    return x.select("channel", "point", params.alias("params"), "loglik", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def gev_path_mode(obs: DataFrame, model: Model, params: dict[str, float], rounds: int = 8) -> DataFrame:
    """(channel, path array<struct<t, eta>>): the most likely location path of extreme-value observations.

    Each round replaces the observations by normal ones with the same slope and curvature at
    the current path, and smooths those; the path starts at the observations."""
    plan = compile_model(model)
    tail = model.observation.tail
    q = {g: F.lit(params[g] ** 2) for g in plan.noise}
    sigma, xi = F.lit(params["sigma"]), F.lit(params["xi"])
    rows = ss.series(obs, ["channel"]).withColumn("eta", F.transform("ys", lambda y: y["y"]))
    for _ in range(rounds):
        def seen(y: Column, eta: Column) -> Column:
            v, r = gev.pseudo_observation(y["y"], eta, sigma, xi, tail)
            return F.struct(y["t"].alias("t"), v.alias("y"), r.alias("r"))

        rows = rows.withColumn("pseudo", F.zip_with("ys", "eta", seen))
        rows = rows.withColumn("path", ss.forward(plan, F.col("pseudo"), q, lambda y: y["r"]))
        rows = rows.withColumn("eta", F.transform(ss.backward(plan, F.col("pseudo"), F.col("path")), lambda s: ss.output(plan, "location", s["m"]))).select("channel", "ys", "eta")
    return rows.select("channel", F.zip_with("ys", "eta", lambda y, e: F.struct(y["t"].alias("t"), e.alias("eta"))).alias("path"))


def combine(*draws: DataFrame) -> DataFrame:
    """Draws of separate runs with chains numbered on; all need the same columns and draws a chain.  ``runs.combine`` also
    checks that they are runs of one thing."""
    out, chains, shape = None, 0, None
    for f in draws:
        got = f.groupBy("chain").agg(F.countDistinct("draw").alias("n")).agg(F.count("chain").alias("chains"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
        if got["lo"] != got["hi"] or (shape is not None and shape != (got["hi"], f.columns)):
            raise ValueError("runs must have the same columns and the same number of draws in each chain")
        shape = (got["hi"], f.columns)
        place = F.dense_rank().over(Window.partitionBy("channel").orderBy("chain")) - 1
        moved = f.withColumn("chain", (place + chains).cast("int"))
        out, chains = moved if out is None else out.unionByName(moved), chains + got["chains"]
    if out is None:
        raise ValueError("nothing to combine")
    return out
