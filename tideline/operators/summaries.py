"""Summaries over draws, risk, return levels, windows, extremes, coverage and counts.

Draw tables are long: (channel, draw or chain and draw, t, ...).  Probabilities are
averaged over draws; what spans blocks is multiplied within a draw first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import gev, normal


def _interval(interval: float) -> tuple[float, float]:
    if not 0 < interval < 1:
        raise ValueError("an interval lies in (0, 1)")
    return (1 - interval) / 2, (1 + interval) / 2


def summarize(rows: DataFrame, by: list[str], value: str, interval: float = 0.95, sd: bool = False) -> DataFrame:
    """(by, mean[, sd], lower, upper): the mean and the central interval, quantiles by the linear rule."""
    lo, hi = _interval(interval)
    x = rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, F.array(F.lit(lo), F.lit(hi))).alias("q"))
    return x.select(*by, "mean", *(["sd"] if sd else []), F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def risk(threshold: Column, tail: str, family: str = "gev", family_tail: str = "upper", eta: str = "location") -> Column:
    """P(Y > threshold) for the upper tail, P(Y <= threshold) for the lower, of one draw at one time."""
    e, s = F.col(eta), F.col("sigma")
    if family == "gaussian":
        return normal.sf(threshold, e, s) if tail == "upper" else normal.cdf(threshold, e, s)
    f = {"upper": gev.sf, "lower": gev.cdf}[tail]
    return f(threshold, e, s, F.col("xi"), family_tail)


def return_level(years: float, tail: str, family: str = "gev", family_tail: str = "upper") -> Column:
    """The level passed once in ``years`` occurrences of a block, on average."""
    if not (1 < years < float("inf")):
        raise ValueError("years must be finite and above 1")
    p = F.lit(1 - 1 / years if tail == "upper" else 1 / years)
    if family == "gaussian":
        return normal.ppf(p, F.col("location"), F.col("sigma"))
    return gev.ppf(p, F.col("location"), F.col("sigma"), F.col("xi"), family_tail)


def by_specification(rows: DataFrame, spec: DataFrame, risk_of: Column) -> DataFrame:
    """Rows with each channel's thresholds (channel, threshold, ...) and ``risk``."""
    return rows.join(spec, "channel").withColumn("risk", risk_of)


def window_risk(rows: DataFrame, by: list[str], risk_column: str = "risk") -> DataFrame:
    """(by, risk): the chance of at least one event over a draw's blocks.  No rows, no groups:
    an empty selection is the caller's error, see ``require_rows``."""
    certain = F.max((F.col(risk_column) >= 1).cast("int")) == 1
    return rows.groupBy(*by).agg(F.when(certain, 1.0).otherwise(-F.expm1(F.sum(F.log1p(-F.col(risk_column))))).alias("risk"))


def require_rows(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise ValueError(f"{what}: nothing selected")
    return rows


def block_extremes(rows: DataFrame, blocks: int, keys: list[str], t: str = "t", y: str = "y") -> DataFrame:
    """(keys, block, largest, smallest) of consecutive groups of ``blocks`` times, from each key's first."""
    first = F.min(t).over(Window.partitionBy(*keys))
    x = rows.withColumn("block", F.floor((F.col(t) - first) / blocks).cast("int"))
    return x.groupBy(*keys, "block").agg(F.max(y).alias("largest"), F.min(y).alias("smallest"), F.count(F.lit(1)).alias("n"))


def require_divisible(extremes: DataFrame, blocks: int) -> DataFrame:
    if not extremes.where(F.col("n") != blocks).isEmpty():
        raise ValueError("the number of times must be a multiple of the block length")
    return extremes


def coverage(pred: DataFrame, observed: DataFrame, levels: tuple[float, ...] = (0.9, 0.95, 0.99)) -> DataFrame:
    """(channel, level, n, coverage, width, below, above): observed (channel, t, y) against central
    intervals of pred (channel, draw, t, y); bounds count as covered."""
    ends = F.array(*(F.lit(v) for level in levels for v in _interval(level)))
    q = pred.groupBy("channel", "t").agg(F.percentile("y", ends).alias("q"))
    x = q.join(observed.select("channel", "t", F.col("y").alias("obs")), ["channel", "t"])
    x = x.select("channel", "t", "obs", F.explode(F.array(*(F.struct(F.lit(v).alias("level"), F.col("q")[2 * i].alias("lo"), F.col("q")[2 * i + 1].alias("hi")) for i, v in enumerate(levels)))).alias("e"))
    x = x.select("channel", "t", "obs", "e.*")
    inside = (F.col("obs") >= F.col("lo")) & (F.col("obs") <= F.col("hi"))
    return x.groupBy("channel", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("hi") - F.col("lo")).alias("width"), F.sum((F.col("obs") < F.col("lo")).cast("long")).alias("below"), F.sum((F.col("obs") > F.col("hi")).cast("long")).alias("above")
    )


def coverage_by_lead(pred: DataFrame, observed: DataFrame, origin: int, per_window: int, level: float = 0.95) -> DataFrame:
    """(channel, window, n, coverage): by windows of so many steps after the origin (a decade: 10 steps a year)."""
    lo, hi = _interval(level)
    q = pred.groupBy("channel", "t").agg(F.percentile("y", F.array(F.lit(lo), F.lit(hi))).alias("q"))
    x = q.join(observed.select("channel", "t", F.col("y").alias("obs")), ["channel", "t"])
    inside = (F.col("obs") >= F.col("q")[0]) & (F.col("obs") <= F.col("q")[1])
    return x.groupBy("channel", F.floor((F.col("t") - origin - 1) / per_window).cast("int").alias("window")).agg(F.count(F.lit(1)).alias("n"), F.avg(inside.cast("double")).alias("coverage"))


def unmatched(pred: DataFrame, observed: DataFrame) -> DataFrame:
    """(channel, t) of forecast or held-out times without their counterpart or a finite value."""
    a = pred.select("channel", "t").distinct().withColumn("_p", F.lit(1))
    b = observed.select("channel", "t", (F.col("y").isNull() | F.isnan("y") | (F.abs("y") == float("inf"))).alias("_bad"), F.lit(1).alias("_o"))
    return a.join(b, ["channel", "t"], "full").where("_p IS NULL OR _o IS NULL OR _bad").select("channel", "t")


def of_phase(rows: DataFrame, period: int, only: int) -> DataFrame:
    """The rows of one phase (a month, a season) of (t, ...)."""
    return rows.where(F.pmod("t", F.lit(period)) == only)


def threshold_counts(rows: DataFrame, observed: DataFrame, spec: DataFrame, tail: str = "upper") -> DataFrame:
    """(channel, threshold, observed, expected, p_at_least, p_at_most): strict exceedances in the data, the expected
    number (mean over draws of summed risks), and how predictive counts compare.

    rows: (channel, draw, t, y, risk, threshold); observed: (channel, t, y); spec: (channel, threshold)."""
    past = lambda y: (y > F.col("threshold")) if tail == "upper" else (y < F.col("threshold"))
    seen = observed.join(spec, "channel").groupBy("channel", "threshold").agg(F.sum(past(F.col("y")).cast("long")).alias("observed"))
    per = rows.groupBy("channel", "threshold", "draw").agg(F.sum("risk").alias("expected"), F.sum(past(F.col("y")).cast("long")).alias("count"))
    x = per.join(seen, ["channel", "threshold"])
    return x.groupBy("channel", "threshold").agg(
        F.max("observed").alias("observed"), F.avg("expected").alias("expected"), F.avg((F.col("count") >= F.col("observed")).cast("double")).alias("p_at_least"), F.avg((F.col("count") <= F.col("observed")).cast("double")).alias("p_at_most")
    )


def mean_error(pred: DataFrame, observed: DataFrame) -> DataFrame:
    """(channel, mean_error): predictive mean less the observation, over time."""
    m = pred.groupBy("channel", "t").agg(F.avg("y").alias("m")).join(observed.select("channel", "t", F.col("y").alias("obs")), ["channel", "t"])
    return m.groupBy("channel").agg(F.avg(F.col("m") - F.col("obs")).alias("mean_error"))


def summary_table(params: DataFrame, paths: DataFrame, interval: float = 0.95) -> DataFrame:
    """(parameter, mean, sd, lower, upper): (channel, parameter, value) rows as ``channel.parameter``, and outputs
    (channel, component, t, value) at each channel's last time as ``channel.component[t=k]``, k from 1."""
    last = F.max("t").over(Window.partitionBy("channel"))
    p = params.select(F.concat_ws(".", "channel", "parameter").alias("parameter"), "value")
    s = paths.withColumn("_last", last).where("t = _last").select(F.concat(F.concat_ws(".", "channel", "component"), F.lit("[t="), (F.col("t") + 1).cast("string"), F.lit("]")).alias("parameter"), "value")
    return summarize(p.unionByName(s), ["parameter"], "value", interval, sd=True)


def path_spread(paths: DataFrame) -> DataFrame:
    """(channel, spread): over time, the largest distance between variants' mean paths (variant, channel, t, mean)."""
    return paths.groupBy("channel", "t").agg((F.max("mean") - F.min("mean")).alias("d")).groupBy("channel").agg(F.max("d").alias("spread"))


def coverage_pivot(table: DataFrame, levels: tuple[float, ...]) -> DataFrame:
    """(origin, channel, one column of percentages a level)."""
    return table.groupBy("origin", "channel").pivot("level", list(levels)).agg(F.first(F.col("coverage") * 100))


def risk_table(rows: DataFrame, spec: DataFrame, tail: str = "upper", interval: float = 0.95, **family) -> DataFrame:
    """(channel, t, threshold, tail, mean, lower, upper): conditional risks of each channel's thresholds
    (channel, threshold), as an export."""
    x = by_specification(rows, spec, risk(F.col("threshold"), tail, **family))
    return summarize(x, ["channel", "t", "threshold"], "risk", interval).withColumn("tail", F.lit(tail))


def records(obs: DataFrame, period: int) -> DataFrame:
    """(channel, phase, t, y, highest, lowest, new_high, new_low): records so far within each phase."""
    x = obs.withColumn("phase", F.pmod("t", F.lit(period)).cast("int"))
    w = Window.partitionBy("channel", "phase").orderBy("t")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_h", F.max("y").over(before)).withColumn("_l", F.min("y").over(before))
    return x.select(
        "channel", "phase", "t", "y", F.greatest("y", "_h").alias("highest"), F.least("y", "_l").alias("lowest"), F.coalesce(F.col("y") > F.col("_h"), F.lit(True)).alias("new_high"), F.coalesce(F.col("y") < F.col("_l"), F.lit(True)).alias("new_low")
    )
