"""Rolling origins: every channel fitted anew to its values up to each origin, and its forecasts scored.

A series is gathered once; each (channel, origin) is a row with the prefix of it up to the origin, so all
refits of all channels are one job and differ only in their keys.  A key names channel and origin, and noise
is hashed from it: a refit equals a separate fit of the same values under the same name.

Defined cases: an origin with fewer than three values before it raises ValueError, as does one without held-out
values; held-out values may end before the horizon (``available`` says how many); null or infinite ones raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import importance, posterior, predictive, summaries
from tideline.plans.model import Model


def key(channel: Column, origin: Column) -> Column:
    return F.concat(channel, F.lit("@"), origin.cast("string"))


def unkeyed(rows: DataFrame, *more: str) -> DataFrame:
    """Rows of keyed channels with their channel, origin and further numbers that the key ends in."""
    parts = F.split("channel", "@")
    last = {name: F.element_at(parts, -i - 1).cast("int") for i, name in enumerate(reversed(("origin", *more)))}
    channel = F.array_join(F.slice(parts, 1, F.size(parts) - len(last)), "@")
    return rows.withColumns({"_channel": channel} | last).drop("channel").withColumnRenamed("_channel", "channel")


def by_model(models: dict[str, Model]) -> list[tuple[Model, list[str]]]:
    """Channels that share a model are fitted together."""
    out: list[tuple[Model, list[str]]] = []
    for channel, model in models.items():
        same = next((names for m, names in out if m == model), None)
        if same is None:
            out.append((model, [channel]))
        else:
            same.append(channel)
    return out


def prefixes(obs: DataFrame, model: Model, origins: list[int]) -> DataFrame:
    """(channel, ys): of each channel and origin the values up to it, from one gathered series."""
    x = importance.gathered(obs, model).withColumn("origin", F.explode(F.array(*(F.lit(o) for o in sorted(set(origins))))))
    return x.select(key(F.col("channel"), F.col("origin")).alias("channel"), F.filter("ys", lambda y: y["t"] <= F.col("origin")).alias("ys"))


def held_out(obs: DataFrame, origins: list[int], horizon: int) -> DataFrame:
    """obs of the ``horizon`` times after each origin, under keyed channels."""
    x = obs.withColumn("_o", F.explode(F.array(*(F.lit(o) for o in sorted(set(origins))))))
    x = x.where((F.col("t") > F.col("_o")) & (F.col("t") <= F.col("_o") + horizon))
    return x.withColumn("channel", key(F.col("channel"), F.col("_o"))).drop("_o")


def refits(obs: DataFrame, models: dict[str, Model], origins: list[int], horizon: int, draws: int = 1000, chains: int = 4, seed: int = 1000, points: int = 400, predictive_draws: int = 1000) -> dict[str, DataFrame]:
    """{posterior, draws, forecast, held} of obs (channel, t, y[, x] ..) under keyed channels: fits to each origin, forecasts
    (channel, draw, t, y, location, sigma, xi, family, tail) and the values they are held against."""
    predictive.whole("horizon", horizon)
    if not origins or any(type(o) is not int for o in origins):
        raise ValueError("origins are whole numbers, one at least")
    obs = obs.where(F.col("channel").isin(*models))
    importance.check(obs)
    before = obs.groupBy("channel").agg(*(F.count_if(F.col("t") <= o).alias(f"n{i}") for i, o in enumerate(origins)), F.max("t").alias("last"))
    least = before.agg(F.min(F.least(F.lit(3), *(F.col(f"n{i}") for i in range(len(origins))))).alias("n"), F.min("last").alias("last")).first()
    if least["n"] is None or least["n"] < 3:
        raise ValueError("an origin has fewer than three values before it")
    if max(origins) >= least["last"]:
        raise ValueError("an origin has no held-out values")
    out: dict[str, DataFrame] = {}
    taken = predictive.draw_index(obs.sparkSession, predictive_draws, chains, draws // chains, seed + 11)
    for model, names in by_model(models):
        fit = posterior.fit_of(prefixes(obs.where(F.col("channel").isin(*names)), model, origins), model, draws, chains, seed, points)
        ahead = predictive.predict(fit["draws"], model, None, horizon, taken, seed + 11).drop("states")
        o = model.observation
        parts = {"posterior": fit["posterior"], "draws": fit["draws"].drop("states"), "forecast": ahead.withColumns({"family": F.lit(o.family), "tail": F.lit(getattr(o, "tail", "upper"))})}
        out = {n: out[n].unionByName(t) if n in out else t for n, t in parts.items()}
    return out | {"held": held_out(obs, origins, horizon)}


def _scores(forecast: DataFrame, held: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    span = held.groupBy("channel").agg(F.count(F.lit(1)).alias("available"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))
    return summaries.coverage(forecast, held, levels).join(summaries.mean_error(forecast, held), "channel").join(span, "channel")


def coverage(fits: dict[str, DataFrame], horizon: int, levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """(origin, channel, level, n, coverage, width, below, above, mean_error, requested, available, first_t, last_t)."""
    return unkeyed(_scores(fits["forecast"], fits["held"], levels)).withColumn("requested", F.lit(horizon))


def coverage_by_window(fits: dict[str, DataFrame], per_window: int, levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """``coverage`` by windows of so many steps after the origin, from 1 on (decades: ten years' steps)."""

    def windowed(rows: DataFrame) -> DataFrame:
        origin = F.element_at(F.split("channel", "@"), -1).cast("int")
        return rows.withColumn("channel", key(F.col("channel"), F.floor((F.col("t") - origin - 1) / per_window).cast("int") + 1))

    return unkeyed(_scores(windowed(fits["forecast"]), windowed(fits["held"]), levels), "window")


def risk(threshold: Column) -> Column:
    """P(Y beyond the threshold of its tail) of each row by its own family: columns family, tail and risk_tail."""
    out = None
    for family, own in (("gaussian", "upper"), ("gev", "upper"), ("gev", "lower")):
        for tail in ("upper", "lower"):
            here = (F.col("family") == family) & (F.col("risk_tail") == tail) & ((F.col("tail") == own) | F.lit(family == "gaussian"))
            value = summaries.risk(threshold, tail, family, own)
            out = F.when(here, value) if out is None else out.when(here, value)
    return out


def threshold_counts(fits: dict[str, DataFrame], spec: DataFrame, phase: Column) -> DataFrame:
    """(origin, channel, threshold, tail, seasons, observed, expected, p_at_least, p_at_most) over the held-out times of each
    channel's phase.  ``spec``: (channel, threshold, tail, phase); ``phase``: of a held-out row, as a month of its ts."""
    rules = spec.select(F.col("channel").alias("_c"), F.col("threshold").cast("double").alias("threshold"), F.col("tail").alias("risk_tail"), F.col("phase").alias("_phase"))
    named = fits["held"].withColumn("_name", F.array_join(F.slice(F.split("channel", "@"), 1, F.size(F.split("channel", "@")) - 1), "@"))
    seen = named.join(rules, F.col("_name") == F.col("_c")).where(phase == F.col("_phase")).select("channel", "t", F.col("y").alias("seen"), "threshold", "risk_tail")
    x = fits["forecast"].join(seen, ["channel", "t"]).withColumn("risk", risk(F.col("threshold")))
    past = lambda y: F.when(F.col("risk_tail") == "upper", y > F.col("threshold")).otherwise(y < F.col("threshold")).cast("long")
    per = x.groupBy("channel", "threshold", "risk_tail", "draw").agg(F.sum("risk").alias("expected"), F.sum(past(F.col("y"))).alias("count"), F.sum(past(F.col("seen"))).alias("observed"), F.count(F.lit(1)).alias("seasons"))
    out = per.groupBy("channel", "threshold", F.col("risk_tail").alias("tail")).agg(
        F.max("seasons").alias("seasons"), F.max("observed").alias("observed"), F.avg("expected").alias("expected"),
        F.avg((F.col("count") >= F.col("observed")).cast("double")).alias("p_at_least"), F.avg((F.col("count") <= F.col("observed")).cast("double")).alias("p_at_most"),
    )
    return unkeyed(out)
