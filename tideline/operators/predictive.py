"""Forecasts, replications and prior simulations as tables of draws.

A predictive table is (channel, draw, t, y, location, sigma, xi): long form, as
everything after it groups by time or by draw.  Propagation is a fold over the
horizon inside each draw's row; noise is hashed from its keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import gev, normal, random
from tideline.operators import importance
from tideline.operators import state_space as ss
from tideline.plans.model import Fixed, Model, MultiSeriesModel, Plan, compile_model


def whole(name: str, value: int, least: int = 1) -> int:
    if type(value) is not int or value < least:
        raise ValueError(f"{name} must be an integer of at least {least}")
    return value


def draw_index(spark: SparkSession, draws: int, chains: int, per_chain: int, seed: int = 2000) -> DataFrame:
    """(pred, chain, draw): posterior draws taken with replacement, the same for all channels."""
    u = random.uniform(seed, F.col("id"))
    flat = F.floor(u * (chains * per_chain))
    return spark.range(whole("draws", draws)).select(F.col("id").cast("int").alias("pred"), F.pmod(flat, F.lit(chains)).cast("int").alias("chain"), F.floor(flat / chains).cast("int").alias("draw"))


def future_calendar(obs: DataFrame, horizon: int, month_step: int | None = None, second_step: int | None = None) -> DataFrame:
    """(channel, t, ts): dates that continue each channel's calendar by months (of period ends) or seconds."""
    whole("horizon", horizon)
    last = obs.groupBy("channel").agg(F.max("t").alias("t0"), F.max("ts").alias("ts0"))
    steps = last.select("channel", "t0", "ts0", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("k"))
    if month_step is not None:
        # a block ends the day before the next one starts
        ts = F.date_sub(F.add_months(F.date_add(F.col("ts0").cast("date"), 1), F.col("k") * month_step), 1).cast("timestamp_ntz")
    elif second_step is not None:
        ts = (F.col("ts0").cast("timestamp").cast("long") + F.col("k") * second_step).cast("timestamp").cast("timestamp_ntz")
    else:
        ts = F.lit(None).cast("timestamp_ntz")
    return steps.select("channel", (F.col("t0") + F.col("k")).cast("int").alias("t"), ts.alias("ts"))


def _walk(plan: Plan, start: Column, amplitude: dict[str, Column], horizon: int, seed: int, key: list[Column], xs: Column | None = None) -> Column:
    """array<struct<k, m, location>> for k = 1 .. horizon."""
    d = len(plan.names)

    def step(acc: Column, e: Column) -> Column:
        k = e["k"]
        move, c = [], 0
        for i in range(d):
            move.append(ss._or0(ss._dot(plan.transition[i], [acc["m"][j] for j in range(d)])))
        for g, cols in plan.noise.items():
            for col in cols:
                for i in range(d):
                    if col[i]:
                        move[i] = move[i] + amplitude[g] * random.gaussian(seed, *key, k, F.lit(c)) * col[i]
                c += 1
        return ss.let(F.array(*move), lambda z: F.struct(z.alias("m"), F.concat(acc["out"], F.array(F.struct(k.alias("k"), z.alias("m"), ss.location_of(plan, z, e).alias("location")))).alias("out")))

    steps = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda k: F.struct(k.alias("k"), *([F.get(xs, k - 1).alias("x")] if xs is not None else [])))
    return F.aggregate(steps, F.struct(start.alias("m"), F.array().cast("array<struct<k:int,m:array<double>,location:double>>").alias("out")), step)["out"]


def observe(rows: DataFrame, family: str, tail: str, seed: int, keys: list[str]) -> DataFrame:
    """Adds y, by the inverse distribution function of a hashed uniform number."""
    u = random.uniform(seed, *map(F.col, keys), F.lit("y"))
    y = normal.ppf(u, F.col("location"), F.col("sigma")) if family == "gaussian" else gev.ppf(u, F.col("location"), F.col("sigma"), F.col("xi"), tail)
    return rows.withColumn("y", y)


def predict(draws: DataFrame, model: Model, n_obs: int | None, horizon: int, taken: DataFrame, seed: int = 2000, future_x: DataFrame | None = None) -> DataFrame:
    """(channel, draw, t, y, location, sigma, xi, states) from the last states of posterior draws; times go on from ``n_obs``,
    or from each draw's own last time.

    ``draws``: (channel, chain, draw, params, states); ``taken``: a draw index, joined by a
    broadcast only as Spark sees fit.  ``future_x``: (channel, xs array<array<double>>)."""
    plan = compile_model(model)
    if plan.features and future_x is None:
        raise ValueError(f"a forecast needs future values of {plan.features}")
    if future_x is not None and not plan.features:
        raise ValueError("the model declares no features")
    x = draws.select("channel", "chain", "draw", "params", F.element_at("states", -1).alias("end")).join(taken, ["chain", "draw"]).drop("draw").withColumnRenamed("pred", "draw")
    if future_x is not None:
        x = x.join(future_x, "channel")
    path = _walk(plan, F.col("end.m"), {g: F.element_at("params", g) for g in plan.noise}, whole("horizon", horizon), seed, [F.col("channel"), F.col("draw")], F.col("xs") if future_x is not None else None)
    sig = importance.sigmas(model, lambda name: F.element_at("params", name))
    xi = F.coalesce(F.element_at("params", "xi"), F.lit(0.0))
    last = F.col("end.t") if n_obs is None else F.lit(n_obs - 1)
    rows = x.select("channel", "draw", sig.alias("sig"), xi.alias("xi"), last.alias("last"), F.explode(path).alias("p")).withColumn("t", (F.col("p.k") + F.col("last")).cast("int"))
    rows = rows.select("channel", "draw", "t", F.col("p.location").alias("location"), importance.sigma_at(model, F.col("sig"), F.col("t")).alias("sigma"), "xi", F.col("p.m").alias("states"))
    return observe(rows, model.observation.family, model.observation.tail, seed, ["channel", "draw", "t"])


def replicate(conditional: DataFrame, taken: DataFrame, family: str, tail: str = "upper", seed: int = 2001) -> DataFrame:
    """In-sample replications of (channel, chain, draw, t, location, sigma, xi), the same draws for all channels."""
    rows = conditional.join(taken, ["chain", "draw"]).drop("chain", "draw").withColumnRenamed("pred", "draw")
    return observe(rows, family, tail, seed, ["channel", "draw", "t"])


def prior_draws(spark: SparkSession, model: Model | MultiSeriesModel, draws: int = 10000, seed: int = 3000) -> DataFrame:
    """(channel, draw, params, state0): parameters from the prior, the shared scales also as ``tau.<group>``."""
    whole("draws", draws)
    multi = model if isinstance(model, MultiSeriesModel) else MultiSeriesModel({"y": model})
    scales = multi.pooling.scales if multi.pooling else {}
    out = None
    for name, m in multi.channels.items():
        plan = compile_model(m)
        d = F.col("draw")
        key = lambda what, shared=False, name=name: (F.lit("" if shared else name), d, F.lit(what))
        tau = {g: F.abs(random.gaussian(seed, *key(f"tau.{g}", True))) * p.sd for g, p in scales.items()}
        params: dict[str, Column] = {f"tau.{g}": v for g, v in tau.items()}
        for g, p in plan.amplitude.items():
            params[g] = F.lit(p.value) if isinstance(p, Fixed) else random.gaussian(seed, *key(g)) * (tau[g] if g in tau else p.sd)
        v = m.priors.variance
        if isinstance(v, Fixed):
            params["variance"] = F.lit(v.value)
        else:
            params["variance"] = v.scale / random.gamma(v.shape, seed, *key("variance"))
        if (seasonal := m.observation.scale) is not None:
            params |= {f"u{i + 1}": random.gaussian(seed, *key(f"u{i + 1}")) * seasonal.prior_sd for i in range(seasonal.period - 1)}
        if m.observation.family == "gev":
            s = m.priors.shape
            params["xi"] = F.lit(s.value) if isinstance(s, Fixed) else s.mean + s.sd * random.gaussian(seed, *key("xi"))
            params["sigma"] = F.sqrt(params["variance"])
        root = _cov_root(plan)
        k = len(plan.names)
        state = F.array(*(F.lit(plan.mean[i]) + sum((random.gaussian(seed, *key(f"state{j}")) * root[i][j] for j in range(k) if root[i][j]), F.lit(0.0)) for i in range(k)))
        rows = spark.range(draws).select(F.lit(name).alias("channel"), F.col("id").cast("int").alias("draw"))
        rows = rows.select("channel", "draw", F.create_map(*(x for n, c in params.items() for x in (F.lit(n), c.cast("double")))).alias("params"), state.alias("state0"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _cov_root(plan: Plan) -> list[list[float]]:
    from tideline.operators.posterior import _root

    return _root(plan.cov)


def prior_predictive(spark: SparkSession, model: Model, steps: int, draws: int = 1000, seed: int = 3000) -> DataFrame:
    """(channel, draw, t, y, location, sigma, xi, states), t from 1 on."""
    plan = compile_model(model)
    x = prior_draws(spark, model, draws, seed)
    path = _walk(plan, F.col("state0"), {g: F.element_at("params", g) for g in plan.noise}, whole("steps", steps), seed, [F.col("channel"), F.col("draw")])
    sig = importance.sigmas(model, lambda name: F.element_at("params", name))
    rows = x.select("channel", "draw", sig.alias("sig"), F.coalesce(F.element_at("params", "xi"), F.lit(0.0)).alias("xi"), F.explode(path).alias("p"))
    # phases start with the first step
    rows = rows.select("channel", "draw", F.col("p.k").alias("t"), F.col("p.location").alias("location"), importance.sigma_at(model, F.col("sig"), F.col("p.k") - 1).alias("sigma"), "xi", F.col("p.m").alias("states"))
    return observe(rows, model.observation.family, model.observation.tail, seed, ["channel", "draw", "t"])


def simulate(spark: SparkSession, model: Model, steps: int, seed: int = 3000) -> DataFrame:
    """One series from the prior: (channel, t, y, location)."""
    return prior_predictive(spark, model, steps, 1, seed).select("channel", "t", "y", "location")
