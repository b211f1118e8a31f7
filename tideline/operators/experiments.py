"""Experiments: configurations that inherit, sensitivity grids, rolling origins, prior calibration."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable, Iterable
from dataclasses import fields, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.model import GEV, DummySeasonal, Gaussian, HalfNormal, InverseGamma, LocalLinearTrend, Model, MultiSeriesModel, Normal, Pooling, Priors, SeasonalScale

#: The configuration key of each normal prior's sd, by the prior's field.
SD_KEYS = {f.name: "xi_sd" if f.name == "shape" else f"{f.name}_sd" for f in fields(Priors) if f.name != "variance"}
# The keys a configuration may have, level by level.
KEYS = {
    "": {"name", "description", "extends", "data", "model", "priors", "pooling", "profiles", "laplace", "forecast_years", "return_years", "risk_thresholds", "validation", "plot", "seed"},
    "data": {"source", "frequency", "series", "start", "end"},
    "model": {"period", "steps_per_year", "level", "slope", "seasonal", "seasonal_scale", "scale_prior_sd"},
    "priors": {*SD_KEYS.values(), "variance_shape", "variance_scale"},
}
PERIODS = {"seasonal": 4, "monthly": 12}
#: What the last letter of a channel's name says of its observations; others are maxima.
FAMILIES = {"m": lambda scale: Gaussian(scale), "n": lambda scale: GEV("lower", scale)}


def leaves(config: dict) -> dict[tuple, object]:
    """The values of a configuration by their paths; an empty level is a value."""
    out, open_ = {}, [((), config)]
    while open_:
        path, value = open_.pop()
        if isinstance(value, dict) and (value or not path):
            open_ += [((*path, k), v) for k, v in value.items()]
        else:
            out[path] = value
    return out


def overlay(*configs: dict) -> dict:
    """One configuration: of the values at a path the last one counts."""
    values: dict[tuple, object] = {}
    for config in configs:
        for path, value in leaves(config).items():
            below = [p for p in values if p[: len(path)] == path]
            if value == {} and below:
                continue
            for p in [*below, *(path[:k] for k in range(1, len(path)))]:
                values.pop(p, None)
            values[path] = value
    out: dict = {}
    for path, value in values.items():
        level = out
        for k in path[:-1]:
            level = level.setdefault(k, {})
        level[path[-1]] = json.loads(json.dumps(value))
    return out


def read_config(path: str | Path) -> dict:
    """A JSON configuration laid over those that it extends; a circle raises ValueError."""
    chain: dict[Path, dict] = {}
    at: Path | None = Path(path).resolve()
    while at is not None:
        if at in chain:
            raise ValueError(f"configurations extend each other in a circle: {at.name}")
        chain[at] = json.loads(at.read_text())
        parent = chain[at].pop("extends", None)
        at = None if parent is None else (at.parent / parent).resolve()
    return overlay(*reversed(chain.values()))


def validate(config: dict) -> dict:
    for level, allowed in KEYS.items():
        if unknown := set(config if not level else config.get(level, {})) - allowed:
            raise ValueError(f"unknown keys in {level or 'the configuration'}: {sorted(unknown)}")
    frequency, period = config.get("data", {}).get("frequency"), config.get("model", {}).get("period")
    if frequency is not None and period is not None and PERIODS.get(frequency) != period:
        raise ValueError(f"a {frequency} series has the period {PERIODS.get(frequency)}, not {period}")
    return config


def priors_of(config: dict) -> Priors:
    given, default = config.get("priors", {}), Priors()
    sds = {field: Normal(0.0, given[key]) for field, key in SD_KEYS.items() if key in given}
    noise = {part: given.get(f"variance_{part}", getattr(default.variance, part)) for part in ("shape", "scale")}
    return replace(default, variance=InverseGamma(**noise), **sds)


def build_model(config: dict) -> MultiSeriesModel:
    """Channels ending in m are means (normal), in n minima (lower extremes), others maxima."""
    spec, priors = config["model"], priors_of(config)
    modes = {group: spec.get(group, "dynamic") for group in ("level", "slope", "seasonal")}
    trend, season = LocalLinearTrend(modes["level"], modes["slope"]), DummySeasonal(spec["period"], modes["seasonal"])
    scale = None
    if spec.get("seasonal_scale"):
        scale = SeasonalScale(spec["period"], spec.get("scale_prior_sd", SeasonalScale.prior_sd))
    channels = {}
    for name in config["data"]["series"]:
        family = FAMILIES.get(name[-1:], lambda s: GEV("upper", s))
        channels[name] = Model(family(scale), (trend, season), priors)
    shared = {group: HalfNormal(getattr(priors, group).sd) for group, mode in modes.items() if mode == "dynamic"}
    wanted = config.get("pooling") == "shared" and bool(shared)
    return MultiSeriesModel(channels, Pooling(**shared) if wanted else None)


def sensitivity_grid(base: dict, variants: dict[str, dict]) -> dict[str, dict]:
    """Name -> configuration, the base first; names must be plain and keys known."""
    out = {"base": validate(base)}
    for name, change in variants.items():
        if name in out or not name or "/" in name or "\\" in name:
            raise ValueError(f"a variant needs a plain name of its own: {name!r}")
        out[name] = validate(overlay(base, change))
    return out


def grid_table(spark: SparkSession, axes: dict[str, list[float]]) -> DataFrame:
    """(variant, axes ...): every combination as a row."""
    rows = [(i, *map(float, v)) for i, v in enumerate(itertools.product(*axes.values()))]
    return spark.createDataFrame(rows, "variant int, " + ", ".join(f"{a} double" for a in axes))


def label_union(tables: Iterable[tuple[str, DataFrame]], label: str) -> DataFrame:
    """Tables of several analyses or origins, with a column that says which."""
    out = None
    for name, t in tables:
        t = t.withColumn(label, F.lit(name))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables")
    return out


def rolling_origins(obs: DataFrame, origins: list[int], horizon: int, forecast: Callable[[DataFrame, int], DataFrame], score: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """For each origin: ``forecast(training rows, horizon)`` scored against the ``horizon`` rows after it.  One plan
    for all origins, so Spark runs them together."""
    return label_union(((str(o), score(forecast(obs.where(F.col("t") <= o), horizon), obs.where((F.col("t") > o) & (F.col("t") <= o + horizon)))) for o in origins), "origin")


def linear_benchmark(obs: DataFrame, horizon: int, variance: float, prior: Normal, thresholds: DataFrame | None = None) -> DataFrame:
    """(channel, t, mean, sd[, threshold, risk]): forecasts of a static line through each channel under a known
    observation variance, with the chance to pass thresholds (channel, threshold)."""
    from tideline.functions import normal
    from tideline.operators.posterior import static_regression

    last = obs.groupBy("channel").agg(F.max("t").alias("last"))
    line = static_regression(obs.withColumn("x", F.array(F.lit(1.0), F.col("t").cast("double"))), 2, prior, variance)
    line = line.groupBy("channel").agg(F.max(F.when(F.col("coefficient") == 0, F.col("mean"))).alias("a"), F.max(F.when(F.col("coefficient") == 1, F.col("mean"))).alias("b"))
    x = line.join(last, "channel").withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("t", (F.col("last") + F.col("k")).cast("int"))
    x = x.select("channel", "t", (F.col("a") + F.col("b") * F.col("t")).alias("mean"), F.lit(variance**0.5).alias("sd"))
    if thresholds is None:
        return x
    return x.join(thresholds, "channel").withColumn("risk", normal.sf(F.col("threshold"), F.col("mean"), F.col("sd")))


def prior_horizon(spark: SparkSession, years: list[int], steps_per_year: int, level_sd: float, slope_sd: float) -> DataFrame:
    """(years, steps, level_variance, slope_variance, total): the variance that a random-walk level and
    slope add over a horizon: h q_level and h (h - 1) (2 h - 1) / 6 q_slope, summed step by step."""
    x = spark.createDataFrame([(y, y * steps_per_year) for y in years], "years int, steps int")
    steps = F.sequence(F.lit(1), F.col("steps"))
    level = F.aggregate(steps, F.lit(0.0), lambda a, k: a + level_sd**2)
    slope = F.aggregate(steps, F.lit(0.0), lambda a, k: a + (F.col("steps") - k) * (F.col("steps") - k) * slope_sd**2)
    return x.select("years", "steps", level.alias("level_variance"), slope.alias("slope_variance"), (level + slope).alias("total"))


def prior_horizon_covariance(spark: SparkSession, years: list[int], steps_per_year: int, level_sd: float, slope_sd: float) -> DataFrame:
    """(years_a, years_b, covariance) between horizons: min(h, k) q_level + sum (h - r)(k - r) q_slope."""
    pairs = [(a, b, a * steps_per_year, b * steps_per_year) for a in years for b in years]
    x = spark.createDataFrame(pairs, "years_a int, years_b int, h int, k int")
    n = F.least("h", "k")
    s = F.aggregate(F.sequence(F.lit(1), n), F.lit(0.0), lambda a, r: a + (F.col("h") - r) * (F.col("k") - r))
    return x.select("years_a", "years_b", (n * level_sd**2 + s * slope_sd**2).alias("covariance"))


def horizon_roots(years: list[int], steps_per_year: int) -> dict[str, list[list[float]]]:
    """Triangular square roots of the covariances between horizons of what level, slope and season innovations of size one add
    to a same-season change: min(h, k); the sum of (h - r)(k - r) over r below both; twice the years in common."""
    from tideline.operators.posterior import _root

    steps = [y * steps_per_year for y in years]
    cov = {
        "level": [[float(min(h, k)) for k in steps] for h in steps],
        "slope": [[float(sum((h - r) * (k - r) for r in range(1, min(h, k)))) for k in steps] for h in steps],
        "seasonal": [[2.0 * min(a, b) for b in years] for a in years],
    }
    return {name: _root(c) for name, c in cov.items()}


#: What the parts of a change are called.
CONTRIBUTIONS = ("level", "slope", "seasonal", "initial_rate", "combined")


def horizon_changes(draws: DataFrame, years: list[int], steps_per_year: int, noise: Callable[[str, int], Column]) -> DataFrame:
    """(channel, draw, years, contribution, value): same-season changes over each horizon that prior draws imply.

    ``draws``: (channel, draw, level, slope, seasonal, initial_slope): amplitudes, and the slope at the start; ``noise(part, j)``: standard
    normal columns, one a part and horizon.  Exact covariances between horizons stand for the states in between."""
    roots = horizon_roots(years, steps_per_year)
    x = draws.withColumns({f"_{g}{j}": noise(g, j) for g in roots for j in range(len(years))})
    each = []
    for i, y in enumerate(years):
        parts = {g: F.col(g) * sum((F.col(f"_{g}{j}") * root[i][j] for j in range(i + 1)), F.lit(0.0)) for g, root in roots.items()}
        each.append(F.struct(F.lit(y).alias("years"), *(v.alias(g) for g, v in parts.items()), (F.col("initial_slope") * (y * steps_per_year)).alias("initial_rate")))
    x = x.select("channel", "draw", F.explode(F.array(*each)).alias("e")).select("channel", "draw", "e.*")
    x = x.withColumn("combined", sum((F.col(c) for c in CONTRIBUTIONS[:-1]), F.lit(0.0)))
    named = F.array(*(F.struct(F.lit(c).alias("contribution"), F.col(c).alias("value")) for c in CONTRIBUTIONS))
    return x.select("channel", "draw", "years", F.explode(named).alias("e")).select("channel", "draw", "years", "e.*")


def horizon_table(changes: DataFrame, thresholds: DataFrame | None = None, accuracy: int = 100_000) -> DataFrame:
    """(channel, years, contribution, mean, sd, lower_95, upper_95, draws[, threshold, share]): quantiles by a mergeable sketch, exact
    up to ``accuracy`` draws; ``thresholds`` (channel, threshold): the share of draws whose change is above."""
    key = ["channel", "years", "contribution"]
    more = []
    if thresholds is not None:
        changes, key = changes.join(thresholds.select("channel", "threshold"), "channel"), [*key, "threshold"]
        more = [F.avg((F.col("value") > F.col("threshold")).cast("double")).alias("share")]
    q = F.percentile_approx("value", F.array(F.lit(0.025), F.lit(0.975)), accuracy)
    x = changes.groupBy(*key).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"), q.alias("q"), F.count(F.lit(1)).alias("draws"), *more)
    return x.select(*key, "mean", "sd", F.col("q")[0].alias("lower_95"), F.col("q")[1].alias("upper_95"), "draws", *(["share"] if more else []))


def calibrate(spark: SparkSession, model: MultiSeriesModel, years: list[int], steps_per_year: int, draws: int = 10_000, seed: int = 19830, thresholds: DataFrame | None = None) -> DataFrame:
    """``horizon_table`` of draws from the priors of all channels, whose shared scales are drawn once a draw."""
    from tideline.functions import random
    from tideline.operators.predictive import prior_draws
    from tideline.plans.model import compile_model

    x = prior_draws(spark, model, draws, seed)
    size = lambda g: F.coalesce(F.abs(F.element_at("params", g)), F.lit(0.0)).alias(g)
    slope = None
    for name, m in model.channels.items():
        at = [i for i, n in enumerate(compile_model(m).names) if n == "slope"]
        own = F.get("state0", F.lit(at[0])) if at else F.lit(0.0)
        slope = F.when(F.col("channel") == name, own) if slope is None else slope.when(F.col("channel") == name, own)
    x = x.select("channel", "draw", size("level"), size("slope"), size("seasonal"), slope.alias("initial_slope"))
    noise = lambda g, j: random.gaussian(seed, F.col("channel"), F.col("draw"), F.lit(f"horizon.{g}"), F.lit(j))
    return horizon_table(horizon_changes(x, years, steps_per_year, noise), thresholds)
