"""Daily observations: scans, and checks that run as one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, day: str = "DAY", values: tuple[str, ...] = ("TX", "TN")) -> DataFrame:
    """A CSV file with a header: (day, values...), only those columns."""
    head = [c for c in spark.read.option("header", True).csv(path).columns]
    schema = ", ".join(f"`{c}` {'date' if c == day else 'double' if c in values else 'string'}" for c in head)
    return spark.read.option("header", True).schema(schema).csv(path).select(F.col(day).alias("day"), *values)


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def not_finite(x: Column) -> Column:
    return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))


def completeness(daily: DataFrame, values: tuple[str, ...], day: str = "day") -> DataFrame:
    """One row: rows, days, first and last day, days between them, values that aren't finite, and ``complete``
    (each day stands once, and all values are finite)."""
    d = F.col(day).cast("date")
    bad = sum(F.sum(not_finite(F.col(v)).cast("long")) for v in values)
    out = daily.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(d).alias("n_days"), F.min(d).alias("first_day"), F.max(d).alias("last_day"), bad.alias("n_bad"))
    span = F.datediff("last_day", "first_day").cast("long") + 1
    return out.select("n_rows", "n_days", "first_day", "last_day", span.alias("n_span"), "n_bad", ((F.col("n_rows") == F.col("n_days")) & (F.col("n_days") == span) & (F.col("n_bad") == 0)).alias("complete"))


def require_complete(daily: DataFrame, values: tuple[str, ...], day: str = "day") -> DataFrame:
    """The table itself, after a check that raises ValueError."""
    got = completeness(daily, values, day).first()
    if not got["complete"]:
        raise ValueError(f"daily values must be finite and each day must stand once: {got.asDict()}")
    return daily


def long_form(wide: DataFrame, channels: list[str], t: str = "t", ts: str | None = None) -> DataFrame:
    """(channel, t, ts, y) from a column for each channel."""
    keys = [t] + ([ts] if ts else [])
    out = wide.select(*keys, *(F.col(c).cast("double") for c in channels)).unpivot(keys, channels, "channel", "y")
    return out.select("channel", F.col(t).cast("int").alias("t"), *([F.col(ts).cast("timestamp_ntz").alias("ts")] if ts else []), "y")
