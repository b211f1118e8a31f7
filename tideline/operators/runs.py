"""Runs on record: from a configuration and observations to a fit, its exports and forecasts, in one folder.

``record`` is written before any work and says whose folder it is: configuration, profile, fingerprint of model and
data, seed and chains.  A run that finds another record raises ValueError; one that finds its own goes on with the
first table that isn't whole (Spark marks those that are), so a lost driver costs one table.  ``manifest`` is written
last: a folder that has it is a finished run, and nothing is computed again.

Chains may be run in folders of their own and combined: they are the chains that a run of all would have.  Parts that
differ in model, data, configuration or draws aren't combined, nor is a chain with itself.

Observations are (channel, t, ts, y): t whole numbers one apart, ts the date of the block.
"""

from __future__ import annotations

import copy
import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import gev, normal
from tideline.operators import diagnostics, experiments, posterior, predictive, summaries, validation
from tideline.plans.model import MultiSeriesModel
from tideline.sources import storage

VERSION = 1
# What each analysis changes of the main one; monthly priors are matched over thirty years.
_MONTHLY = {
    "data": {"frequency": "monthly"}, "model": {"period": 12, "steps_per_year": 12},
    "priors": {"level_sd": 0.05773502691896258, "slope_sd": 0.0003832923311016883, "initial_slope_sd": 0.0033333333333333335},
}
ANALYSES = {
    "main": [],
    "monthly": [_MONTHLY],
    "private": [{"pooling": "private"}],
    "constant_dispersion": [{"model": {"seasonal_scale": False}}],
    "monthly_constant_dispersion": [_MONTHLY, {"pooling": "private", "model": {"seasonal_scale": False}}],
}


def analysis(base: dict, name: str) -> dict:
    """The configuration of one of the five analyses, over a base."""
    if name not in ANALYSES:
        raise ValueError(f"no analysis {name!r}")
    return experiments.validate(experiments.overlay(base, *ANALYSES[name], {"name": name}))


def read_text(spark: SparkSession, path: str) -> str | None:
    """The one text of a JSON folder; None where it isn't there or isn't whole."""
    p, fs = storage._hadoop(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        return None
    row = spark.read.schema("text string, sha256 string").json(path).first()
    if row is None or hashlib.sha256(row["text"].encode()).hexdigest() != row["sha256"]:
        raise ValueError(f"{path} is damaged")
    return row["text"]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    row = (text, hashlib.sha256(text.encode()).hexdigest())
    spark.createDataFrame([row], "text string, sha256 string").coalesce(1).write.mode("overwrite").json(path)


def step(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, made only if it isn't whole."""
    p, fs = storage._hadoop(spark, f"{path}/_SUCCESS")
    if not fs.exists(p):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def selected(obs: DataFrame, config: dict, settings: dict, end: str | None = None) -> DataFrame:
    """The configured channels from ``start`` to ``end``, or the first ``max_blocks`` of them."""
    x = obs.select("channel", F.col("t").cast("int").alias("t"), "ts", F.col("y").cast("double").alias("y")).where(F.col("channel").isin(*config["data"]["series"]))
    if start := config["data"].get("start"):
        x = x.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end := end or config["data"].get("end"):
        x = x.where(F.col("ts") < F.lit(end).cast("timestamp_ntz") + F.expr("interval 1 day"))
    if most := settings.get("max_blocks"):
        first = x.groupBy("channel").agg(F.min("t").alias("first"))
        x = x.join(first, "channel").where(F.col("t") < F.col("first") + most).drop("first")
    return x


def _identity(config: dict, profile: str, settings: dict, end: str | None, fingerprint: str) -> dict:
    return {"version": VERSION, "config": config, "profile": profile, "settings": settings, "end": end, "fingerprint": fingerprint, "seed": config.get("seed", 1000)}


def fits_of(obs: DataFrame, model: MultiSeriesModel, settings: dict, seed: int, only: tuple[int, ...] | None) -> dict[str, DataFrame]:
    """{posterior, draws, outputs, effective} of all channels; those with one model are one fit, pooled if the model says so."""
    chains = settings["chains"]
    out: dict[str, DataFrame] = {}
    for one, names in validation.by_model(model.channels):
        fit = posterior.fit(obs.where(F.col("channel").isin(*names)), one, settings["draws"] * chains, chains, seed, settings.get("points", 400), model.pooling, only=only)
        out = {n: out[n].unionByName(fit[n], allowMissingColumns=True) if n in out else fit[n] for n in ("posterior", "draws", "outputs", "effective")}
    return out


def conditional(draws: DataFrame, outputs: DataFrame, obs: DataFrame, model: MultiSeriesModel) -> DataFrame:
    """(channel, chain, draw, t, y, location, sigma, xi, family, tail): what each draw says of each observation."""
    where = outputs.where("component = 'location'").select("channel", "chain", "draw", "t", F.col("value").alias("location"))
    out = None
    for one, names in validation.by_model(model.channels):
        mine = draws.where(F.col("channel").isin(*names))
        s = posterior.sigma(mine, one).join(mine.select("channel", "chain", "draw", F.coalesce(F.element_at("params", "xi"), F.lit(0.0)).alias("xi")), ["channel", "chain", "draw"])
        s = s.withColumns({"family": F.lit(one.observation.family), "tail": F.lit(getattr(one.observation, "tail", "upper"))})
        out = s if out is None else out.unionByName(s)
    return out.join(where, ["channel", "chain", "draw", "t"]).join(obs.select("channel", "t", "y"), ["channel", "t"])


def distribution(rows: DataFrame) -> DataFrame:
    """Adds u, each row's distribution function at y by its family."""
    y, e, s, xi = (F.col(c) for c in ("y", "location", "sigma", "xi"))
    u = F.when(F.col("family") == "gaussian", normal.cdf(y, e, s)).when(F.col("tail") == "upper", gev.cdf(y, e, s, xi, "upper")).otherwise(gev.cdf(y, e, s, xi, "lower"))
    return rows.withColumn("u", u)


def observed_anew(rows: DataFrame, seed: int) -> DataFrame:
    """Rows with y drawn from each row's own distribution."""
    out = None
    for family, tail in (("gaussian", "upper"), ("gev", "upper"), ("gev", "lower")):
        own = rows.where((F.col("family") == family) & (F.lit(family == "gaussian") | (F.col("tail") == tail))).drop("y")
        own = predictive.observe(own, family, tail, seed, ["channel", "chain", "draw", "t"])
        out = own if out is None else out.unionByName(own)
    return out


def exports(spark: SparkSession, output: str, draws: DataFrame, outputs: DataFrame, obs: DataFrame, model: MultiSeriesModel, settings: dict, seed: int) -> dict[str, DataFrame]:
    """{posterior_summary, posterior_checks, residual_association}, written in ``output``."""
    params = draws.select("channel", F.explode("params").alias("parameter", "value"))
    some = draws.where(F.col("draw") < settings.get("check_draws", settings["draws"]))
    rows = distribution(conditional(some, outputs, obs, model))
    key = ["channel", "chain", "draw"]
    numbered = lambda x: diagnostics.ks_distance(x, key).select("channel", F.concat_ws(".", "chain", "draw").alias("draw"), "distance")
    return {
        "posterior_summary": step(spark, f"{output}/posterior_summary", lambda: summaries.summary_table(params, outputs)),
        "posterior_checks": step(spark, f"{output}/posterior_checks", lambda: diagnostics.posterior_checks(numbered(rows), numbered(distribution(observed_anew(rows.drop("u"), seed + 5))))),
        "residual_association": step(spark, f"{output}/residual_association", lambda: diagnostics.residual_association(diagnostics.normal_scores(rows))),
    }


def forecasts(spark: SparkSession, output: str, draws: DataFrame, model: MultiSeriesModel, config: dict, settings: dict) -> dict[str, DataFrame]:
    """{forecasts[, risks]}: predictive intervals over the horizon, and chances to pass the configured thresholds."""
    seed, horizon = config.get("seed", 1000) + 11, int(config["forecast_years"] * config["model"]["steps_per_year"])
    got = draws.agg(F.countDistinct("chain").alias("chains"), F.countDistinct("draw").alias("n")).first()

    def predicted() -> DataFrame:
        # chains of a part keep their own numbers
        x = draws.withColumn("chain", (F.dense_rank().over(Window.partitionBy("channel").orderBy("chain")) - 1).cast("int"))
        taken = predictive.draw_index(spark, settings["predictive_draws"], got["chains"], got["n"], seed)
        out = None
        for one, names in validation.by_model(model.channels):
            p = predictive.predict(x.where(F.col("channel").isin(*names)), one, None, horizon, taken, seed).drop("states")
            p = p.withColumns({"family": F.lit(one.observation.family), "tail": F.lit(getattr(one.observation, "tail", "upper"))})
            out = p if out is None else out.unionByName(p)
        return out

    rows = step(spark, f"{output}/predictive", predicted)
    out = {"forecasts": step(spark, f"{output}/forecasts", lambda: summaries.summarize(rows, ["channel", "t"], "y"))}
    spec = [(c, float(r["threshold"]), r["tail"]) for c, r in config.get("risk_thresholds", {}).items() if c in model.channels]
    if spec:
        rules = spark.createDataFrame(spec, "channel string, threshold double, risk_tail string")
        x = rows.join(F.broadcast(rules), "channel").withColumn("risk", validation.risk(F.col("threshold")))  # a row a channel
        out["risks"] = step(spark, f"{output}/risks", lambda: summaries.summarize(x, ["channel", "t", "threshold", "risk_tail"], "risk"))
    return out


def run(spark: SparkSession, config: dict, obs: DataFrame, output: str, profile: str = "screen", chain: int | None = None, channel: str | None = None, end: str | None = None) -> dict[str, DataFrame]:
    """The tables of a run in ``output``: {observations, posterior, draws, outputs, effective, posterior_summary, posterior_checks,
    residual_association, forecasts[, risks]}.  ``chain``: only that one, for ``combine``; ``channel``: only that one."""
    config = copy.deepcopy(config)
    settings = dict(config["profiles"][profile])
    if channel is not None:
        if config.get("pooling") == "shared":
            raise ValueError("a pooled fit needs all channels")
        if channel not in config["data"]["series"]:
            raise ValueError(f"no channel {channel!r} in the configuration")
        config["data"]["series"] = [channel]
    if chain is not None and not 0 <= chain < settings["chains"]:
        raise ValueError(f"chains are numbered from 0 to {settings['chains'] - 1}")
    model, seed, output = experiments.build_model(config), config.get("seed", 1000), output.rstrip("/")
    data = selected(obs, config, settings, end)
    if missing := set(config["data"]["series"]) - {r["channel"] for r in data.select("channel").distinct().collect()}:
        raise ValueError(f"no observations of {sorted(missing)}")
    mark = storage.fingerprint(model, data, config["model"]["steps_per_year"])
    chains = list(range(settings["chains"])) if chain is None else [chain]
    record = json.dumps(_identity(config, profile, settings, end, mark) | {"chains": chains}, sort_keys=True)
    found = read_text(spark, f"{output}/record")
    if found is not None and found != record:
        raise ValueError(f"{output} belongs to another run")
    if found is None:
        write_text(spark, f"{output}/record", record)
    if (done := read_text(spark, f"{output}/manifest")) is not None:
        return {n: spark.read.parquet(f"{output}/{n}") for n in json.loads(done)["tables"]}
    data = step(spark, f"{output}/observations", lambda: data)
    fit: dict[str, DataFrame] = {}

    def part(name: str) -> Callable[[], DataFrame]:
        def make() -> DataFrame:
            if not fit:
                fit.update(fits_of(data, model, settings, seed, None if chain is None else (chain,)))
            return fit[name]

        return make

    tables = {"observations": data} | {n: step(spark, f"{output}/{n}", part(n)) for n in ("posterior", "draws", "outputs", "effective")}
    tables |= exports(spark, output, tables["draws"], tables["outputs"], data, model, settings, seed)
    if config.get("forecast_years"):
        tables |= forecasts(spark, output, tables["draws"], model, config, settings)
    write_text(spark, f"{output}/manifest", json.dumps({"tables": sorted(tables), "fingerprint": mark}, sort_keys=True))
    return tables


def combine(spark: SparkSession, parts: list[str], output: str) -> dict[str, DataFrame]:
    """The finished runs in ``parts`` as one: their chains under their own numbers, with exports of all of them."""
    if not parts:
        raise ValueError("nothing to combine")
    records = []
    for p in parts:
        text = read_text(spark, f"{p.rstrip('/')}/record")
        if text is None or read_text(spark, f"{p.rstrip('/')}/manifest") is None:
            raise ValueError(f"{p} is no finished run")
        records.append(json.loads(text))
    first = {k: v for k, v in records[0].items() if k != "chains"}
    for p, r in zip(parts, records):
        if r["fingerprint"] != first["fingerprint"]:
            raise ValueError(f"{p} is of another model, calendar or data")
        if {k: v for k, v in r.items() if k not in ("chains", "seed", "config")} != {k: v for k, v in first.items() if k not in ("seed", "config")} or r["settings"]["draws"] != first["settings"]["draws"]:
            raise ValueError(f"{p} was run in another way")
    streams = [(r["seed"], c) for r in records for c in r["chains"]]
    if len(set(streams)) != len(streams):
        raise ValueError("a chain occurs twice: choose other chains or seeds")
    output = output.rstrip("/")
    record = json.dumps(first | {"streams": streams, "combined": True}, sort_keys=True)
    if (found := read_text(spark, f"{output}/record")) not in (None, record):
        raise ValueError(f"{output} belongs to another run")
    if found is None:
        write_text(spark, f"{output}/record", record)
    if (done := read_text(spark, f"{output}/manifest")) is not None:
        return {n: spark.read.parquet(f"{output}/{n}") for n in json.loads(done)["tables"]}
    place = {s: i for i, s in enumerate(sorted(streams))}

    def together(name: str) -> DataFrame:
        out = None
        for p, r in zip(parts, records):
            number = F.create_map(*(F.lit(x) for c in r["chains"] for x in (c, place[r["seed"], c])))
            x = spark.read.parquet(f"{p.rstrip('/')}/{name}")
            x = x.withColumn("chain", F.element_at(number, F.col("chain")))
            out = x if out is None else out.unionByName(x)
        return out

    config, settings = first["config"], first["settings"]
    model = experiments.build_model(config)
    data = step(spark, f"{output}/observations", lambda: spark.read.parquet(f"{parts[0].rstrip('/')}/observations"))
    tables = {"observations": data} | {n: step(spark, f"{output}/{n}", lambda n=n: together(n)) for n in ("draws", "outputs")}
    tables |= exports(spark, output, tables["draws"], tables["outputs"], data, model, settings, first["seed"])
    if config.get("forecast_years"):
        tables |= forecasts(spark, output, tables["draws"], model, config, settings)
    write_text(spark, f"{output}/manifest", json.dumps({"tables": sorted(tables), "fingerprint": first["fingerprint"]}, sort_keys=True))
    return tables
