"""The tables behind plots: each type is a function registered by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.operators.diagnostics import acf, qq
from tideline.operators.state_space import let
from tideline.operators.summaries import summarize

TYPES: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, *aliases: str):
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        for n in (name, *aliases):
            if n in TYPES:
                raise ValueError(f"plot type {n} exists")
            TYPES[n] = f
        return f

    return add


def frame(kind: str, *args, **kwargs) -> DataFrame:
    if kind not in TYPES:
        raise ValueError(f"unknown plot type {kind!r}; there are {sorted(TYPES)}")
    return TYPES[kind](*args, **kwargs)


@register("trajectory", "level", "slope", "location", "seasonal", "component", "risk", "return_level")
def trajectory(paths: DataFrame, value: str = "value", interval: float = 0.95, phase: int | None = None, period: int | None = None, scale: float = 1.0) -> DataFrame:
    """Mean and band by channel and time, optionally of one phase; ``scale``: for slopes a decade, 10 * steps a year."""
    x = paths if phase is None else paths.where(F.pmod("t", F.lit(period)) == phase)
    return summarize(x.withColumn("_v", F.col(value) * scale), ["channel", "t"], "_v", interval)


@register("forecast")
def forecast(pred: DataFrame, observed: DataFrame | None = None, interval: float = 0.95) -> DataFrame:
    """Predictive mean and band, the mean location, and what was observed."""
    x = summarize(pred, ["channel", "t"], "y", interval).join(pred.groupBy("channel", "t").agg(F.avg("location").alias("location")), ["channel", "t"])
    return x if observed is None else x.join(observed.select("channel", "t", F.col("y").alias("observed")), ["channel", "t"], "left")


@register("seasonal_cycle", "cycle")
def seasonal_cycle(paths: DataFrame, period: int, interval: float = 0.95) -> DataFrame:
    """The seasonal effects of the first and the last full period, by phase."""
    w = Window.partitionBy("channel")
    x = paths.withColumn("_a", F.min("t").over(w)).withColumn("_b", F.max("t").over(w))
    which = F.when(F.col("t") < F.col("_a") + period, "initial").when(F.col("t") > F.col("_b") - period, "final")
    x = x.withColumn("cycle", which).where("cycle IS NOT NULL").withColumn("phase", F.pmod("t", F.lit(period)).cast("int"))
    return summarize(x, ["channel", "cycle", "phase"], "value", interval)


@register("risk_curve")
def risk_curve(rows: DataFrame, thresholds: list[float], risk_of, t: int, interval: float = 0.95) -> DataFrame:
    """Band of the risk by threshold at one time; ``risk_of``: threshold column -> risk column."""
    x = rows.where(F.col("t") == t).withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    return summarize(x.withColumn("risk", risk_of(F.col("threshold"))), ["channel", "threshold"], "risk", interval)


@register("observation_scale")
def observation_scale(rows: DataFrame, period: int, interval: float = 0.95) -> DataFrame:
    return summarize(rows.withColumn("phase", F.pmod("t", F.lit(period)).cast("int")), ["channel", "phase"], "sigma", interval)


@register("pit")
def pit_histogram(pit: DataFrame, bins: int = 10, value: str = "pit") -> DataFrame:
    """(channel, bin, n, density) of values in [0, 1]."""
    x = pit.withColumn("bin", F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int"))
    n = F.sum(F.count(F.lit(1))).over(Window.partitionBy("channel"))
    return x.groupBy("channel", "bin").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * bins / n).alias("density"))


register("normal_qq")(qq)
register("acf")(acf)


@register("trace")
def trace(draws: DataFrame, parameter: str) -> DataFrame:
    return draws.select("channel", "chain", "draw", F.element_at("params", parameter).alias("value"))


@register("posterior", "prior_posterior")
def density(values: DataFrame, key: list[str], value: str = "value", points: int = 250) -> DataFrame:
    """(key, x, density): a normal kernel estimate on a grid over the .1 to 99.9 % range, bandwidth
    n ** -0.2 sample standard deviations.  Grid points are exploded on rows and summed: partial sums
    before the shuffle, so draws aren't gathered."""
    s = values.groupBy(*key).agg(F.percentile(value, F.array(F.lit(0.001), F.lit(0.999))).alias("q"), F.stddev_samp(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("h", F.col("sd") * F.pow("n", F.lit(-0.2)))
    x = values.join(s, key).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = x.withColumn("x", F.col("q")[0] + (F.col("q")[1] - F.col("q")[0]) * F.col("i") / (points - 1))
    z = (F.col("x") - F.col(value)) / F.col("h")
    return x.groupBy(*key, "x").agg((F.sum(F.exp(-z * z / 2)) / F.max(F.col("n") * F.col("h")) / 2.5066282746310002).alias("density"))


def loess(points: DataFrame, span: float = 0.5, t: str = "t", y: str = "y") -> DataFrame:
    """(channel, t, smooth): a local line with tricube weights over the nearest ceil(span * n) points, three at least.

    A channel's points are one sorted array, in which a point's nearest ones stand together; where they begin is
    found by halving, and only they are summed: memory is that of the array, work that of the neighbourhoods."""
    a = points.groupBy("channel").agg(F.array_sort(F.collect_list(F.struct(F.col(t).cast("double").alias("t"), F.col(y).cast("double").alias("y")))).alias("p"))
    a = a.withColumn("n", F.size("p")).withColumn("k", F.least(F.greatest(F.ceil(F.col("n") * F.lit(span)).cast("int"), F.lit(3)), F.col("n")))
    time = lambda i: F.get("p", i)["t"]

    def begin(x0: Column) -> Column:
        # the window moves on while the point after it is nearer than its first
        far = lambda i: (i + F.col("k") < F.col("n")) & (x0 - time(i) > time(i + F.col("k")) - x0)
        steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda j: F.pow(F.lit(2.0), j.cast("double")).cast("int"))
        return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.col("n") - F.col("k")) & far(at + s - 1), at + s).otherwise(at))

    def line(x0: Column, at: Column) -> Column:
        h = F.greatest(x0 - time(at), time(at + F.col("k") - 1) - x0)
        wide = F.when(h > 0, h).otherwise(1.0)

        def add(s: Column, e: Column) -> Column:
            def summed(c: Column) -> Column:
                return F.struct((s["w"] + c["w"]).alias("w"), (s["wx"] + c["w"] * c["x"]).alias("wx"), (s["wy"] + c["w"] * e["y"]).alias("wy"), (s["wxx"] + c["w"] * c["x"] * c["x"]).alias("wxx"), (s["wxy"] + c["w"] * c["x"] * e["y"]).alias("wxy"))

            x = e["t"] - x0
            u = F.least(F.abs(x) / wide, F.lit(1.0))
            return let(F.struct(x.alias("x"), F.pow(1 - F.pow(u, F.lit(3.0)), F.lit(3.0)).alias("w")), summed)

        def solved(s: Column) -> Column:
            det = s["w"] * s["wxx"] - s["wx"] * s["wx"]
            return F.when(det > 1e-12 * s["w"] * s["w"], (s["wxx"] * s["wy"] - s["wx"] * s["wxy"]) / det).otherwise(s["wy"] / s["w"])

        zero = F.struct(*(F.lit(0.0).alias(n) for n in ("w", "wx", "wy", "wxx", "wxy")))
        return let(F.aggregate(F.slice("p", at + 1, F.col("k")), zero, add), solved)

    smooth = F.transform("p", lambda e: F.struct(e["t"].cast("int").alias("t"), let(begin(e["t"]), lambda at: line(e["t"], at)).alias("smooth")))
    return a.select("channel", F.explode(smooth).alias("e")).select("channel", "e.*")
