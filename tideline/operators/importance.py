"""Posteriors of scales, seasonal scales and shapes by adaptive importance sampling.

A channel's free parameters (amplitudes and variance as logarithms) are proposed from
Student distributions, weighted by likelihood and prior, and the proposal of the next
round takes its centre and spread from those weights; weights that rest on few points
are flattened before.  So the range follows the posterior, whatever the prior's scale.
Every (channel, point) is a row.  Rows of a channel stay where its series was gathered:
one shuffle for all rounds.  A channel's points are a parameter, not a share of the data.

Normal observations have exact likelihoods.  Extreme-value ones are replaced by normal
ones with the same slope and curvature at the most likely path; paths drawn from those
are weighted by the true density over the replaced one and taken anew, which is exact as
the number of draws grows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import gev, normal, random
from tideline.functions.scale import contrasts, phase
from tideline.operators import state_space as ss
from tideline.plans.model import Fixed, InverseGamma, Model, Normal, Plan, Pooling, compile_model

#: Powers that weights are flattened to, the largest first that leaves a fifth of the points in effect.
POWERS = tuple(2.0**-k for k in range(16))
#: Stands for the log weight of an impossible point.
IMPOSSIBLE = -1e300


@dataclass(frozen=True)
class Parameter:
    name: str
    prior: Normal | InverseGamma
    log: bool

    def value(self, theta: Column) -> Column:
        return F.exp(theta) if self.log else theta

    def density(self, theta: Column) -> Column:
        """Log prior density of theta, up to a constant; an amplitude is a size, so its normal is folded."""
        if isinstance(self.prior, InverseGamma):
            return -self.prior.shape * theta - self.prior.scale * F.exp(-theta)
        if self.log:
            return theta - 0.5 * F.exp(2 * theta) / self.prior.sd**2
        return -0.5 * F.pow((theta - self.prior.mean) / self.prior.sd, F.lit(2.0))


def parameters(model: Model) -> tuple[list[Parameter], dict[str, float]]:
    """The free parameters and the values of the fixed ones: amplitudes by group, variance, u1 .. of a seasonal
    scale, xi of an extreme-value family."""
    priors = compile_model(model).amplitude | {"variance": model.priors.variance}
    logs = set(priors)
    if (s := model.observation.scale) is not None:
        priors |= {f"u{i + 1}": Normal(0.0, s.prior_sd) for i in range(s.period - 1)}
    if model.observation.family == "gev":
        priors["xi"] = model.priors.shape
    free = [Parameter(n, p, n in logs) for n, p in priors.items() if not isinstance(p, Fixed)]
    return free, {n: float(p.value) for n, p in priors.items() if isinstance(p, Fixed)}


def sigmas(model: Model, value) -> Column:
    """array<double> of sigma by phase (one phase without a seasonal scale); ``value(name)`` gives a parameter."""
    sigma = F.sqrt(value("variance"))
    if model.observation.scale is None:
        return F.array(sigma)
    p = model.observation.scale.period
    return F.array(*(sigma * F.exp(sum((value(f"u{i + 1}") * c for i, c in enumerate(row)), F.lit(0.0))) for row in contrasts(p)))


def sigma_at(model: Model, by_phase: Column, t: Column) -> Column:
    period = model.observation.scale.period if model.observation.scale is not None else 1
    return F.get(by_phase, phase(t, period))


def _entry(y: Column, value: Column, r: Column, features: bool) -> Column:
    return F.struct(y["t"].alias("t"), value.alias("y"), r.alias("r"), *([y["x"].alias("x")] if features else []))


def _replaced(plan: Plan, model: Model, ys: Column, eta: Column, by_phase: Column, xi: Column) -> Column:
    """Normal observations that stand for extreme-value ones at a path; beyond the support, at the observation."""
    tail = model.observation.tail

    def one(y: Column, e: Column) -> Column:
        def at(s: Column) -> Column:
            safe = F.when(F.isnan(gev.gradient(y["y"], e, s, xi, tail)), y["y"]).otherwise(e)
            return ss.let(safe, lambda z: _entry(y, *gev.pseudo_observation(y["y"], z, s, xi, tail), bool(plan.features)))

        return ss.let(sigma_at(model, by_phase, y["t"]), at)

    return F.zip_with(ys, eta, one)


def mode(plan: Plan, model: Model, ys: Column, q: dict[str, Column], by_phase: Column, xi: Column, rounds: int = 6) -> Column:
    """array<double>: the most likely path of the location, from the observations on."""

    def again(eta: Column, _: Column) -> Column:
        def smooth(seen: Column) -> Column:
            states = ss.backward(plan, seen, ss.forward(plan, seen, q, lambda y: y["r"]))
            return F.zip_with(states, seen, lambda s, y: ss.location_of(plan, s["m"], y))

        return ss.let(_replaced(plan, model, ys, eta, by_phase, xi), smooth)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.transform(ys, lambda y: y["y"]), again)


def gain(model: Model, ys: Column, seen: Column, eta: Column, by_phase: Column, xi: Column) -> Column:
    """Log density of the observations less that of those that stand for them, at a path."""

    def one(e: Column) -> Column:
        true = gev.logpdf(e["ys"]["y"], e["eta"], sigma_at(model, by_phase, e["ys"]["t"]), xi, model.observation.tail)
        return true - normal.logpdf(e["seen"]["y"], e["eta"], F.sqrt(e["seen"]["r"]))

    return F.aggregate(F.arrays_zip(ys.alias("ys"), seen.alias("seen"), eta.alias("eta")), F.lit(0.0), lambda a, e: a + one(e))


def observed(rows: DataFrame, model: Model, value, rounds: int = 6) -> DataFrame:
    """Adds sig (sigma by phase), seen (normal observations with their variances r) and offset: the log density
    that the likelihood of ``seen`` lacks at the mode, zero for normal observations."""
    plan = compile_model(model)
    rows = rows.withColumn("sig", sigmas(model, value))
    if model.observation.family == "gaussian":
        seen = F.transform("ys", lambda y: ss.let(sigma_at(model, F.col("sig"), y["t"]), lambda s: _entry(y, y["y"], s * s, bool(plan.features))))
        return rows.withColumn("seen", seen).withColumn("offset", F.lit(0.0))
    xi, q = value("xi"), {g: value(g) * value(g) for g in plan.noise}
    rows = rows.withColumn("eta", mode(plan, model, F.col("ys"), q, F.col("sig"), xi, rounds))
    rows = rows.withColumn("seen", _replaced(plan, model, F.col("ys"), F.col("eta"), F.col("sig"), xi))
    return rows.withColumn("offset", gain(model, F.col("ys"), F.col("seen"), F.col("eta"), F.col("sig"), xi)).drop("eta")


def _weighed(rows: DataFrame, model: Model, free: list[Parameter], fixed: dict[str, float], n: int, seed: int, step: int) -> DataFrame:
    """(channel, ys, point, theta, params, loglik, lw): n points of each channel from its centre and spread."""
    plan = compile_model(model)
    rows = rows.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    key = [F.col("channel"), F.lit(step), F.col("point")]
    each = F.sequence(F.lit(0), F.lit(len(free) - 1)) if free else F.array().cast("array<int>")
    student = F.transform(each, lambda j: random.gaussian(seed, *key, j) / F.sqrt(random.gamma_integer(2, seed, *key, 1000 + j) / 2))
    rows = rows.withColumn("z", student)
    rows = rows.withColumn("theta", F.zip_with(F.zip_with("z", "spread", lambda a, b: a * b), "centre", lambda a, b: a + b))
    proposal = sum((-2.5 * F.log1p(F.col("z")[j] * F.col("z")[j] / 4) - F.log(F.col("spread")[j]) for j in range(len(free))), F.lit(0.0))
    prior = sum((p.density(F.col("theta")[j]) for j, p in enumerate(free)), F.lit(0.0))
    names = [p.name for p in free] + list(fixed)
    at = {name: f"_p{j}" for j, name in enumerate(names)}
    values = [p.value(F.col("theta")[j]) for j, p in enumerate(free)] + [F.lit(v) for v in fixed.values()]
    rows = rows.withColumns({at[name]: v for name, v in zip(names, values)} | {"outside": prior - proposal})
    value = lambda name: F.col(at[name])
    rows = observed(rows, model, value)
    rows = rows.withColumn("loglik", F.col("offset") + ss.likelihood(plan, F.col("seen"), {g: value(g) * value(g) for g in plan.noise}, lambda y: y["r"]))
    lw = F.col("loglik") + F.col("outside")
    possible = lw.isNotNull() & ~F.isnan(lw) & (F.abs(lw) < 1e290)
    params = F.create_map(*(x for name in names for x in (F.lit(name), value(name))))
    return rows.select("channel", "ys", "point", "theta", params.alias("params"), "loglik", F.when(possible, lw).otherwise(IMPOSSIBLE).alias("lw"))


def _adapted(rows: DataFrame, k: int, n: int) -> DataFrame:
    """(channel, ys, centre, spread) of the next round."""
    x = rows.groupBy("channel").agg(F.first("ys").alias("ys"), F.collect_list(F.struct("theta", "lw")).alias("pts"))
    x = x.withColumn("top", F.array_max(F.transform("pts", lambda p: p["lw"])))
    total = lambda f: F.aggregate("pts", F.lit(0.0), lambda a, p: a + f(p))
    weight = lambda p, power: F.exp(power * (p["lw"] - F.col("top")))
    enough = F.filter(F.array(*map(F.lit, POWERS)), lambda b: total(lambda p: weight(p, b)) * total(lambda p: weight(p, b)) >= n / 5 * total(lambda p: weight(p, 2 * b)))
    x = x.withColumn("power", F.coalesce(F.get(enough, F.lit(0)), F.lit(POWERS[-1])))
    x = x.withColumn("mass", total(lambda p: weight(p, F.col("power"))))
    x = x.withColumn("centre", F.array(*(total(lambda p, j=j: weight(p, F.col("power")) * p["theta"][j]) / F.col("mass") for j in range(k))))
    square = lambda p, j: F.pow(p["theta"][j] - F.col("centre")[j], F.lit(2.0))
    spread = F.array(*(F.greatest(F.sqrt(total(lambda p, j=j: weight(p, F.col("power")) * square(p, j)) / F.col("mass")), F.lit(1e-3)) for j in range(k)))
    return x.select("channel", "ys", "centre", spread.alias("spread"))


def gathered(obs: DataFrame, model: Model) -> DataFrame:
    """(channel, ys): each channel's series, with the features that the model needs."""
    features = compile_model(model).features
    if features and "x" not in obs.columns:
        raise ValueError(f"the model needs features {features} in a column x")
    return ss.series(obs, ["channel"], x="x" if features else None)


def posterior(obs: DataFrame, model: Model, points: int = 400, rounds: int = 3, seed: int = 1000) -> DataFrame:
    """(channel, point, params, loglik, weight) for every channel; see ``effective``.

    Empty tables give no rows; extra columns are left out; t, y and channel must not be null (see ``check``)."""
    return posterior_of(gathered(obs, model), model, points, rounds, seed)


def posterior_of(rows: DataFrame, model: Model, points: int = 400, rounds: int = 3, seed: int = 1000) -> DataFrame:
    """``posterior`` of series (channel, ys)."""
    free, fixed = parameters(model)
    # the variance starts at half the mean square of steps, all else at its prior
    step = F.zip_with(F.slice("ys", F.lit(2), F.size("ys")), "ys", lambda a, b: F.coalesce(a["y"] - b["y"], F.lit(0.0)))
    rough = F.aggregate(step, F.lit(0.0), lambda a, d: a + d * d) / F.greatest(F.size("ys") - 1, F.lit(1)) / 2
    first = {p.name: (F.log(F.greatest(rough, F.lit(1e-12))), 1.0) if p.name == "variance" else (F.lit(math.log(p.prior.sd) - 0.7), 1.2) if p.log else (F.lit(p.prior.mean), p.prior.sd) for p in free}
    centre, spread = F.array(*(c for c, _ in first.values())), F.array(*(F.lit(float(s)) for _, s in first.values()))
    rows = rows.select("channel", "ys", centre.alias("centre"), spread.alias("spread"))
    if not free:
        empty = F.array().cast("array<double>")
        return _shares(_weighed(rows.withColumns({"centre": empty, "spread": empty}), model, free, fixed, 1, seed, 0))
    for i in range(rounds):
        n = max(points // 2, 50)
        rows = _adapted(_weighed(rows, model, free, fixed, n, seed, i), len(free), n)
    return _shares(_weighed(rows, model, free, fixed, points, seed, rounds))


def _shares(x: DataFrame) -> DataFrame:
    w = Window.partitionBy("channel")
    x = x.withColumn("e", F.exp(F.col("lw") - F.max("lw").over(w)))
    return x.select("channel", "point", "params", "loglik", (F.col("e") / F.sum("e").over(w)).alias("weight"))


def effective(weights: DataFrame) -> DataFrame:
    """(channel, points, effective): how many equal points the weights are worth."""
    return weights.groupBy("channel").agg(F.count("weight").alias("points"), (F.pow(F.sum("weight"), F.lit(2.0)) / F.sum(F.col("weight") * F.col("weight"))).alias("effective"))


def take(weights: DataFrame, draws: int, chains: int = 4, offset: float = 0.5, keys: tuple[str, ...] = ("channel",)) -> DataFrame:
    """``draws`` rows of each key by systematic resampling: (keys, chain, draw, params ...)."""
    w = Window.partitionBy(*keys).orderBy("point")
    upto = F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("weight").over(Window.partitionBy(*keys))
    x = weights.withColumn("_hi", F.greatest(F.lit(0), F.least(F.lit(draws), F.ceil(upto / total * draws - offset)))).withColumn("_lo", F.lag("_hi", 1, 0).over(w))
    x = x.where("_hi > _lo").withColumn("_d", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    return x.withColumn("draw", F.floor(F.col("_d") / chains).cast("int")).withColumn("chain", F.pmod("_d", F.lit(chains)).cast("int")).drop("_hi", "_lo", "_d", "weight")


def _scales(spark: SparkSession, pooling: Pooling, n: int) -> DataFrame:
    """(scale, tau array): n points of the shared scales, each as likely as the next a priori."""
    steps = [math.sqrt(p) % 1.0 for p in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)]
    if len(pooling.scales) > len(steps):
        raise ValueError(f"pooling takes up to {len(steps)} groups")
    part = lambda i: F.pmod((F.col("id") + 0.5) * steps[i], F.lit(1.0)) if len(pooling.scales) > 1 else (F.col("id") + 0.5) / n
    tau = [normal.ppf0(0.5 + part(i) / 2) * p.sd for i, p in enumerate(pooling.scales.values())]
    return spark.range(n).select(F.col("id").cast("int").alias("scale"), F.array(*tau).alias("tau"))


def pooled(own: DataFrame, model: Model, pooling: Pooling, draws: int, chains: int = 4, seed: int = 1000, scales: int = 200) -> tuple[DataFrame, DataFrame]:
    """(shared, taken): the posterior (scale, tau, weight) of scales that all channels share, and draws
    (channel, chain, draw, params with ``tau.<group>``) of channels' own parameters under the scale of each draw.

    Each channel's points, weighted under amplitudes of the model's own priors, are weighted anew under each scale;
    their sums are the channel's likelihood of it, and those multiply over the channels (one sum for each scale)."""
    plan = compile_model(model)
    groups = list(pooling.scales)
    if lost := [g for g in groups if not isinstance(plan.amplitude.get(g), Normal)]:
        raise ValueError(f"no free amplitude to pool: {lost}")
    spark = own.sparkSession
    grid = _scales(spark, pooling, scales)
    amp = lambda g: F.element_at("params", g)
    ratio = F.lit(0.0)
    for i, g in enumerate(groups):
        sd, tau = plan.amplitude[g].sd, F.col("tau")[i]
        ratio = ratio - 0.5 * amp(g) * amp(g) * (1 / (tau * tau) - 1 / sd**2) - F.log(tau / sd)
    # the scales are a table of fixed size; each point meets all of them, as a likelihood needs
    cells = own.join(F.broadcast(grid.groupBy().agg(F.collect_list(F.struct("scale", "tau")).alias("s"))), how="left").withColumn("s", F.explode("s"))
    cells = cells.select("channel", "point", "params", "weight", "s.*").withColumn("share", F.when(F.col("weight") > 0, F.exp(F.log("weight") + ratio)).otherwise(0.0))
    each = cells.groupBy("channel", "scale").agg(F.sum("share").alias("likelihood"))
    shared = each.groupBy("scale").agg(F.sum(F.when(F.col("likelihood") > 0, F.log("likelihood")).otherwise(IMPOSSIBLE)).alias("lw")).join(grid, "scale")
    top = shared.agg(F.max("lw").alias("top"))
    shared = shared.join(F.broadcast(top), how="left").withColumn("weight", F.exp(F.col("lw") - F.col("top"))).select("scale", "tau", "weight")
    chosen = take(shared.withColumn("channel", F.lit("")).withColumnRenamed("scale", "point"), draws, chains).select(F.col("point").alias("scale"), "chain", "draw")
    w = Window.partitionBy("channel", "scale").orderBy("point")
    upto = cells.withColumn("hi", F.sum("share").over(w)).withColumn("all", F.sum("share").over(Window.partitionBy("channel", "scale"))).withColumn("lo", F.col("hi") - F.col("share"))
    picked = upto.join(chosen, "scale").withColumn("u", random.uniform(seed, F.col("channel"), F.col("chain"), F.col("draw"), F.lit("pool")) * F.col("all"))
    picked = picked.where("u > lo AND u <= hi")
    tau = F.create_map(*(x for i, g in enumerate(groups) for x in (F.lit(f"tau.{g}"), F.col("tau")[i])))
    return shared, picked.select("channel", "chain", "draw", F.map_concat("params", tau).alias("params"))


def check(obs: DataFrame) -> None:
    """Raises ValueError unless every channel has at least three finite values, and times one apart without repeats."""
    ok = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") < math.inf)
    each = obs.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("finite"), F.countDistinct("t").alias("times"), (F.max("t") - F.min("t") + 1).alias("span"))
    bad = each.agg(F.count_if(F.col("finite") < F.col("n")).alias("finite"), F.count_if(F.col("n") < 3).alias("length"), F.count_if((F.col("times") < F.col("n")) | (F.col("span") != F.col("n"))).alias("calendar")).first()
    wrong = {"values that aren't finite": bad["finite"], "fewer than three values": bad["length"], "gaps or repeats in time": bad["calendar"]}
    if any(wrong.values()):
        raise ValueError("channels can't be fitted: " + ", ".join(f"{n} with {what}" for what, n in wrong.items() if n))
