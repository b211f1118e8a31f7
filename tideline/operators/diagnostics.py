"""Convergence and fit diagnostics as grouped and windowed plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import normal
from tideline.sources.scratch import settle

NAN = float("nan")


def average_rank(value: Column, by: list[str]) -> Column:
    """Ranks from 1 on, ties at their mean."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def split(draws: DataFrame, key: list[str]) -> DataFrame:
    """Each chain in halves ``part`` (a middle draw of an odd number drops out; under four draws a
    chain stays whole)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*key, "chain"))
    i = F.row_number().over(Window.partitionBy(*key, "chain").orderBy("draw"))
    half = F.floor(F.col("_n") / 2)
    x = draws.withColumn("_n", n).withColumn("_i", i)
    part = F.when(half < 2, 0).when(F.col("_i") <= half, 0).when(F.col("_i") > F.col("_n") - half, 1)
    return x.withColumn("part", part).where("part IS NOT NULL").drop("_n", "_i")


def _scores(x: DataFrame, key: list[str], value: str) -> DataFrame:
    n = F.count(F.lit(1)).over(Window.partitionBy(*key))
    return x.withColumn("_r", average_rank(F.col(value), key)).withColumn("_z", normal.ppf0((F.col("_r") - 0.375) / (n + 0.25)))


def _rhat(x: DataFrame, key: list[str]) -> DataFrame:
    per = x.groupBy(*key, "chain", "part").agg(F.avg("_z").alias("m"), F.var_samp("_z").alias("v"), F.count(F.lit(1)).alias("n"))
    g = per.groupBy(*key).agg(F.var_samp("m").alias("b"), F.avg("v").alias("w"), F.max("n").alias("n"), F.countDistinct("chain").alias("chains"))
    value = F.sqrt((F.col("n") - 1) / F.col("n") + F.try_divide("b", "w"))
    return g.select(*key, F.when(F.col("w") <= 0, F.when(F.col("b") <= 1e-300, 1.0).otherwise(float("inf"))).otherwise(value).alias("r"), "chains")


def rhat(draws: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, rhat): the larger of the rank-normalized split statistic and that of values folded about their
    median; NaN for one chain or a constant.  draws: (key, chain, draw, value)."""
    x = split(draws, key)
    bulk = _rhat(_scores(x, key, value), key)
    med = F.percentile(value, 0.5).over(Window.partitionBy(*key))
    folded = _rhat(_scores(x.withColumn("_m", med).withColumn("_f", F.abs(F.col(value) - F.col("_m"))), key, "_f"), key)
    const = draws.groupBy(*key).agg((F.min(value) == F.max(value)).alias("constant"))
    out = bulk.join(folded.select(*key, F.col("r").alias("f")), key).join(const, key)
    return out.select(*key, F.when(F.col("constant") | (F.col("chains") < 2), NAN).otherwise(F.greatest("r", "f")).alias("rhat"))


#: Lags of the first group; each further one is twice as wide.
LAGS = 64


def _ess(x: DataFrame, key: list[str], z: str) -> DataFrame:
    """Effective sizes by Geyer's monotone sequence; z: a column of scores, chains of equal length.

    A chain is one array.  Its autocovariances come in groups of lags, a row a lag, and only keys whose pairs of lags
    were all positive so far go on to the next group: white noise ends in the first, in work proportional to its length."""
    per = x.groupBy(*key, "chain", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", z))), lambda e: e[z]).alias("zs"))
    per = per.withColumn("n", F.size("zs")).withColumn("m", F.aggregate("zs", F.lit(0.0), lambda a, v: a + v) / F.size("zs"))
    per = settle(per.select(*key, "chain", "part", "n", "m", F.transform("zs", lambda v: v - F.col("m")).alias("c")), "chains")
    lagged = lambda k: F.aggregate(F.zip_with(F.slice("c", F.lit(1), F.col("n") - k), F.slice("c", k + 1, F.col("n") - k), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v) / F.col("n")
    base = per.groupBy(*key).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("k"), F.var_samp("m").alias("b"), F.avg(lagged(F.lit(0))).alias("a0"))
    base = base.withColumn("within", F.col("a0") * F.col("n") / F.greatest(F.col("n") - 1, F.lit(1)))
    base = settle(base.withColumn("plus", F.col("within") * (F.col("n") - 1) / F.col("n") + F.coalesce("b", F.lit(0.0))), "base")
    # an odd last lag has no partner, unless it is the only one
    last = F.greatest(F.floor(F.col("n") / 2).cast("int") * 2, F.lit(1))
    lo, hi, groups, going = 0, LAGS, None, per
    while True:
        some = going.where(last > lo).select(*key, F.posexplode(F.transform(F.sequence(F.lit(lo), F.least(F.lit(hi), last) - 1), lagged)).alias("i", "a"))
        some = some.groupBy(*key, (F.col("i") + lo).alias("lag")).agg(F.avg("a").alias("a")).join(base, key)
        rho = F.when(F.col("lag") == 0, 1.0).otherwise(1 - F.try_divide(F.col("within") - F.col("a"), F.col("plus")))
        some = settle(some.groupBy(*key, F.floor(F.col("lag") / 2).cast("int").alias("pair")).agg(F.sum(rho).alias("p"), F.count(rho).alias("_c"), F.count(F.lit(1)).alias("_d")), "pairs")
        # a constant has no correlations
        some = some.withColumn("p", F.when(F.col("_c") == F.col("_d"), F.col("p"))).drop("_c", "_d")
        groups = some if groups is None else groups.unionByName(some)
        ended = some.where("p <= 0 OR p IS NULL").select(*key).distinct()
        rest = base.where(last > hi).select(*key).join(ended, key, "left_anti")
        rest = rest if lo == 0 else rest.join(some.select(*key).distinct(), key, "left_semi")
        if rest.isEmpty():
            break
        going, lo, hi = per.join(settle(rest, "rest"), key, "left_semi"), hi, hi + 2 * (hi - lo)
    # positive pairs from the first on, none above the one before
    w = Window.partitionBy(*key).orderBy("pair").rowsBetween(Window.unboundedPreceding, 0)
    groups = groups.withColumn("_on", F.min(F.coalesce((F.col("p") > 0).cast("int"), F.lit(0))).over(w)).withColumn("_low", F.min("p").over(w))
    total = groups.groupBy(*key).agg(F.sum(F.when(F.col("_on") == 1, F.col("_low")).otherwise(0.0)).alias("s")).join(base, key)
    size = F.col("n") * F.col("k")
    return total.select(*key, F.least(size.cast("double"), size / F.greatest(2 * F.col("s") - 1, F.lit(1e-12))).alias("ess"), size.cast("double").alias("total"))


def ess_bulk(draws: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, ess): bulk effective sample size; NaN for a constant, the number of draws below three."""
    x = _scores(split(draws, key), key, value)
    const = draws.groupBy(*key).agg((F.min(value) == F.max(value)).alias("constant"), F.count(F.lit(1)).alias("all"))
    out = _ess(x, key, "_z").join(const, key)
    return out.select(*key, F.when(F.col("constant"), NAN).otherwise(F.least("ess", F.col("all").cast("double"))).alias("ess"))


def ess_tail(draws: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """(key, ess): the smaller effective size of the indicators of the 5 % and 95 % quantiles."""
    w = Window.partitionBy(*key)
    x = split(draws, key).withColumn("_q", F.percentile(value, F.array(F.lit(0.05), F.lit(0.95))).over(w))
    parts = [_ess(_scores(x.withColumn("_i", (F.col(value) <= F.col("_q")[i]).cast("double")), key, "_i"), key, "_z").select(*key, F.col("ess").alias(f"e{i}")) for i in (0, 1)]
    const = draws.groupBy(*key).agg((F.min(value) == F.max(value)).alias("constant"))
    return parts[0].join(parts[1], key).join(const, key).select(*key, F.when(F.col("constant"), NAN).otherwise(F.least("e0", "e1")).alias("ess"))


def normal_scores(pit: DataFrame, value: str = "u") -> DataFrame:
    """(channel, t, score): mean over draws of the normal quantiles of conditional distribution values."""
    u = F.greatest(F.least(F.col(value), F.lit(1 - 1e-12)), F.lit(1e-12))
    return pit.groupBy("channel", "t").agg(F.avg(normal.ppf0(u)).alias("score"))


def predictive_pit(pit: DataFrame, value: str = "u") -> DataFrame:
    return pit.groupBy("channel", "t").agg(F.avg(value).alias("pit"))


def ks_distance(pit: DataFrame, key: list[str], value: str = "u") -> DataFrame:
    """(key, distance): the largest distance of a draw's values from the uniform distribution."""
    w = Window.partitionBy(*key)
    x = pit.withColumn("_i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return x.groupBy(*key).agg(F.max(F.greatest(F.col("_i") / F.col("_n") - F.col(value), F.col(value) - (F.col("_i") - 1) / F.col("_n"))).alias("distance"))


def posterior_checks(data: DataFrame, replicated: DataFrame) -> DataFrame:
    """(channel, distance, replicated, p_value) from distances (channel, draw, distance) of data and replications."""
    x = data.join(replicated.withColumnRenamed("distance", "r"), ["channel", "draw"])
    return x.groupBy("channel").agg(F.avg("distance").alias("distance"), F.avg("r").alias("replicated"), F.avg((F.col("r") >= F.col("distance")).cast("double")).alias("p_value"))


def residual_association(scores: DataFrame) -> DataFrame:
    """(channel_a, channel_b, correlation) of scores at equal times."""
    a = scores.select(F.col("channel").alias("channel_a"), "t", F.col("score").alias("a"))
    b = scores.select(F.col("channel").alias("channel_b"), "t", F.col("score").alias("b"))
    return a.join(b, "t").groupBy("channel_a", "channel_b").agg(F.corr("a", "b").alias("correlation"))


def qq(scores: DataFrame, value: str = "score") -> DataFrame:
    """(channel, i, theoretical, sample): sorted values against normal quantiles of (i - 1/2) / n."""
    w = Window.partitionBy("channel")
    x = scores.withColumn("i", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    return x.select("channel", "i", normal.ppf0((F.col("i") - 0.5) / F.col("_n")).alias("theoretical"), F.col(value).alias("sample"))


def acf(scores: DataFrame, max_lag: int = 20, value: str = "score") -> DataFrame:
    """(channel, lag, acf), lag 0 is 1.  Lagged values come from one window; times are consecutive."""
    w = Window.partitionBy("channel")
    x = scores.withColumn("_z", F.col(value) - F.avg(value).over(w))
    x = x.withColumns({f"_l{k}": F.lag("_z", k).over(w.orderBy("t")) for k in range(1, max_lag + 1)})
    g = x.groupBy("channel").agg(F.sum(F.col("_z") * F.col("_z")).alias("s0"), F.count(F.lit(1)).alias("n"), *(F.sum(F.col("_z") * F.col(f"_l{k}")).alias(f"s{k}") for k in range(1, max_lag + 1)))
    each = F.array(*(F.struct(F.lit(k).alias("lag"), (F.col(f"s{k}") / F.col("s0")).alias("acf")) for k in range(max_lag + 1)))
    return g.where("s0 > 0").select("channel", F.explode(each).alias("e")).select("channel", "e.*").where("acf IS NOT NULL")
