"""Calendar blocks of daily values, their completeness, phases and calendar checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Months in a block, and by how many months its start is shifted from the calendar's.
FREQUENCIES = {"monthly": (1, 0), "seasonal": (3, -1)}


def block_start(day: Column, frequency: str) -> Column:
    """First day of the block: the month, or the season from December, March, June or September on."""
    if frequency == "monthly":
        return F.trunc(day, "month")
    if frequency == "seasonal":
        return F.add_months(F.trunc(F.add_months(day, 1), "quarter"), -1)
    raise ValueError(f"frequency must be one of {sorted(FREQUENCIES)}")


def block_end(start: Column, frequency: str) -> Column:
    return F.date_sub(F.add_months(start, FREQUENCIES[frequency][0]), 1)


def audit(daily: DataFrame, frequency: str, day: str = "day") -> DataFrame:
    """(block_start, block_end, n_days, n_expected, complete, boundary) of every block with a day."""
    d = F.col(day).cast("date")
    out = daily.groupBy(block_start(d, frequency).alias("block_start")).agg(F.countDistinct(d).alias("n_days"))
    end = block_end(F.col("block_start"), frequency)
    expected = (F.datediff(end, F.col("block_start")) + 1).cast("long")
    every = Window.partitionBy(F.lit(0))  # a row for each block, not for each day
    edge = (F.col("block_start") == F.min("block_start").over(every)) | (F.col("block_start") == F.max("block_start").over(every))
    return out.select("block_start", end.alias("block_end"), "n_days", expected.alias("n_expected"), (F.col("n_days") == expected).alias("complete"), edge.alias("boundary"))


def summaries(daily: DataFrame, frequency: str, values: tuple[str, ...], day: str = "day") -> DataFrame:
    """(block_end, <value>_mean, <value>_max, <value>_min ...) of the complete blocks, labelled by
    their last day; incomplete first and last blocks drop out.  ``incomplete_interior`` names what must be empty."""
    d = F.col(day).cast("date")
    stats = [f(F.col(v)).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    out = daily.groupBy(block_start(d, frequency).alias("block_start")).agg(F.countDistinct(d).alias("n_days"), *stats)
    end = block_end(F.col("block_start"), frequency)
    return out.where(F.col("n_days") == F.datediff(end, F.col("block_start")) + 1).select(end.alias("block_end"), *(f"{v}_{n}" for v in values for n in ("mean", "max", "min")))


def incomplete_interior(daily: DataFrame, frequency: str, day: str = "day") -> DataFrame:
    return audit(daily, frequency, day).where("NOT complete AND NOT boundary")


def require_blocks(daily: DataFrame, frequency: str, values: tuple[str, ...], day: str = "day") -> DataFrame:
    """``summaries``, after a check that no interior block lacks days."""
    bad = incomplete_interior(daily, frequency, day).orderBy("block_start").first()
    if bad is not None:
        raise ValueError(f"incomplete interior block: {bad.asDict()}")
    return summaries(daily, frequency, values, day)


def phase_label(ts: Column, frequency: str) -> Column:
    """Month name, or DJF, MAM, JJA, SON, by the month a block ends in."""
    if frequency == "monthly":
        return F.date_format(ts, "MMM")
    m = F.month(ts)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def number(blocks: DataFrame, order: str, channel: list[str] | None = None) -> DataFrame:
    """Adds t = 0, 1, 2 ... by channel."""
    w = Window.partitionBy(*(channel or [F.lit(0)])).orderBy(order)
    return blocks.withColumn("t", (F.row_number().over(w) - 1).cast("int"))


def regularity(obs: DataFrame, ts: str = "ts", channel: str = "channel") -> DataFrame:
    """(channel, n, n_null, n_not_increasing, month_step, second_step, regular): one month step, or one step in
    seconds, between all neighbours; null steps where they differ."""
    w = Window.partitionBy(channel).orderBy(ts)
    t, before = F.col(ts).cast("timestamp"), F.lag(F.col(ts).cast("timestamp")).over(w)
    # block labels are period ends: a day later is the next period's start
    a, b = F.date_add(t.cast("date"), 1), F.date_add(before.cast("date"), 1)
    months = F.when((F.dayofmonth(a) == F.dayofmonth(b)), (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b))
    x = obs.select(channel, F.col(ts).alias("_t"), before.alias("_b"), months.alias("_m"), (t.cast("long") - before.cast("long")).alias("_s"))
    x = x.groupBy(channel).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("_t").isNull().cast("long")).alias("n_null"), F.sum(F.coalesce((F.col("_s") <= 0).cast("long"), F.lit(0))).alias("n_not_increasing"),
        F.min("_m").alias("m0"), F.max("_m").alias("m1"), F.count("_m").alias("nm"), F.min("_s").alias("s0"), F.max("_s").alias("s1"), F.count("_b").alias("nb"),
    )
    month = F.when((F.col("m0") == F.col("m1")) & (F.col("nm") == F.col("nb")) & (F.col("m0") > 0), F.col("m0"))
    second = F.when((F.col("s0") == F.col("s1")) & (F.col("s0") > 0), F.col("s0"))
    return x.select(channel, "n", "n_null", "n_not_increasing", month.cast("int").alias("month_step"), second.alias("second_step"), ((F.col("n_null") == 0) & (F.col("n_not_increasing") == 0) & (month.isNotNull() | second.isNotNull())).alias("regular"))


def centred(obs: DataFrame, period: int, y: str = "y") -> DataFrame:
    """Adds phase and ``centred``: y less its mean over the channel's phase."""
    x = obs.withColumn("phase", F.pmod("t", F.lit(period)).cast("int"))
    return x.withColumn("centred", F.col(y) - F.avg(y).over(Window.partitionBy("channel", "phase")))


def align(obs: DataFrame, exog: DataFrame, features: list[str]) -> DataFrame:
    """Observations with ``x array<double>`` of the named features in that order, joined on t (and channel
    where exog has one).  ``unaligned`` names what must be empty."""
    keys = ["channel", "t"] if "channel" in exog.columns else ["t"]
    return obs.join(exog.select(*keys, F.array(*(F.col(f).cast("double") for f in features)).alias("x")), keys)


def unaligned(obs: DataFrame, exog: DataFrame, features: list[str]) -> DataFrame:
    """Keys on one side only, or with a feature that isn't finite."""
    keys = ["channel", "t"] if "channel" in exog.columns else ["t"]
    bad = F.lit(False)
    for f in features:
        x = F.col(f).cast("double")
        bad = bad | x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    left = obs.select(*keys).distinct().withColumn("_o", F.lit(1))
    both = left.join(exog.select(*keys, bad.alias("_bad"), F.lit(1).alias("_e")), keys, "full")
    return both.where("_o IS NULL OR _e IS NULL OR _bad").select(*keys)
