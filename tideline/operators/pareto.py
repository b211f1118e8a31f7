"""Generalized Pareto fits to the largest importance weights of each channel.

The shape of the fit says how heavy the tail of the weights is: above 0.7 a mean over them can't be trusted, whatever
their effective number looks like.  Smoothed weights have the largest ones replaced by quantiles of the fit.  The fit is
Zhang and Stephens's: candidates of a scale are rows, their profile likelihoods grouped sums, and the scale is their mean
by likelihood; a weak prior draws the shape towards one half.  A channel's tail is at most 3 sqrt(n) of its n weights.

Weights need not add up to one.  Ties share their order; a channel whose tail has fewer than ``LEAST`` weights, or whose
tail is one value, has the shape null and keeps its weights; null weights count as zero.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A tail needs so many weights; from this shape on weights aren't to be trusted; the prior of the shape: its worth in weights.
LEAST, TRUST, PRIOR = 5, 0.7, 10.0


def _tails(weights: DataFrame) -> DataFrame:
    """(channel, i, x, m, cut): the m largest weights of each channel, less the largest one that isn't among them; i from 1 upward."""
    w = Window.partitionBy("channel")
    x = weights.select("channel", F.coalesce("weight", F.lit(0.0)).alias("w"))
    x = x.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_down", F.row_number().over(w.orderBy(F.desc("w"))))
    m = F.ceil(F.least(F.col("_n") / 5, 3 * F.sqrt("_n"))).cast("int")
    x = x.withColumn("m", m).where("_down <= m + 1")
    cut = F.max(F.when(F.col("_down") == F.col("m") + 1, F.col("w"))).over(w)
    x = x.withColumn("cut", cut).where(F.col("_down") <= F.col("m"))
    return x.select("channel", (F.col("m") - F.col("_down") + 1).alias("i"), (F.col("w") - F.col("cut")).alias("x"), "m", "cut")


def fit(weights: DataFrame) -> DataFrame:
    """(channel, m, cut, shape, scale) of (channel, weight)."""
    tails = _tails(weights)
    about = tails.groupBy("channel").agg(
        F.max("m").alias("m"), F.max("cut").alias("cut"), F.max("x").alias("top"), F.min("x").alias("low"), F.max(F.when(F.col("i") == F.floor(F.col("m") / 4 + 0.5).cast("int"), F.col("x"))).alias("quarter")
    )
    fits = (F.col("m") >= LEAST) & (F.col("top") > F.col("low")) & (F.col("quarter") > 0)
    count = F.lit(30) + F.floor(F.sqrt("m")).cast("int")
    grid = about.where(fits).withColumn("j", F.explode(F.sequence(F.lit(1), count)))
    theta = 1 / F.col("top") + (1 - F.sqrt(count / (F.col("j") - 0.5))) / (3 * F.col("quarter"))
    grid = grid.select("channel", "j", theta.alias("theta"))
    # a channel has some 40 candidates and at most 3 sqrt(n) weights in its tail
    each = grid.join(tails, "channel").groupBy("channel", "j", "theta", "m").agg(F.avg(F.log1p(-F.col("theta") * F.col("x"))).alias("k"))
    each = each.withColumn("l", F.col("m") * (F.log(F.try_divide(-F.col("theta"), F.col("k"))) - F.col("k") - 1))
    best = each.groupBy("channel").agg(F.max("l").alias("top"))
    each = each.join(best, "channel").withColumn("e", F.exp(F.col("l") - F.col("top")))
    mean = each.groupBy("channel").agg((F.sum(F.col("theta") * F.col("e")) / F.sum("e")).alias("theta"))
    shapes = mean.join(tails, "channel").groupBy("channel", "theta", "m").agg(F.avg(F.log1p(-F.col("theta") * F.col("x"))).alias("k"))
    shapes = shapes.select("channel", (-F.col("k") / F.col("theta")).alias("scale"), ((F.col("m") * F.col("k") + PRIOR * 0.5) / (F.col("m") + PRIOR)).alias("shape"))
    return about.select("channel", "m", "cut").join(shapes, "channel", "left").select("channel", "m", "cut", "shape", "scale")


def shape(weights: DataFrame) -> DataFrame:
    """(channel, shape)."""
    return fit(weights).select("channel", "shape")


def smoothed(weights: DataFrame) -> DataFrame:
    """The rows with their weights smoothed: the largest of each channel by the quantiles of its fit, none above the largest
    there was, and all divided by their sum (zero where that is zero)."""
    w = Window.partitionBy("channel")
    x = weights.withColumn("_w", F.coalesce("weight", F.lit(0.0))).withColumn("_down", F.row_number().over(w.orderBy(F.desc("_w"))))
    f = fit(weights).withColumnsRenamed({"channel": "_c", "m": "_m", "cut": "_cut", "shape": "_k", "scale": "_s"})
    x = x.join(f, F.col("channel") == F.col("_c")).drop("_c")
    p = (F.col("_m") - F.col("_down") + 0.5) / F.col("_m")
    quantile = F.col("_cut") + F.col("_s") / F.col("_k") * F.expm1(-F.col("_k") * F.log1p(-p))
    x = x.withColumn("_v", F.when((F.col("_down") <= F.col("_m")) & F.col("_k").isNotNull(), F.least(quantile, F.max("_w").over(w))).otherwise(F.col("_w")))
    return x.withColumn("weight", F.coalesce(F.try_divide("_v", F.sum("_v").over(w)), F.lit(0.0))).drop("_w", "_down", "_m", "_cut", "_k", "_s", "_v")


def warn(worth: DataFrame) -> None:
    """Warns of channels whose weights, of points or of paths, have too heavy a tail."""
    columns = [c for c in ("shape", "shape_paths") if c in worth.columns]
    counts = worth.agg(*(F.count_if(F.col(c) > TRUST).alias(c) for c in columns)).first()
    for c in columns:
        if counts[c]:
            what = "points" if c == "shape" else "paths"
            warnings.warn(f"{counts[c]} channels have weights of {what} with a Pareto shape above {TRUST}: take more {what}", stacklevel=3)
