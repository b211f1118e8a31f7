"""Phases, seasonal contrasts and seasonal scales."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def phase(t: Column, period: int) -> Column:
    """0 for the first observation, whatever its calendar date."""
    return F.pmod(t, F.lit(period)).cast("int")


def contrasts(period: int) -> list[list[float]]:
    """period x (period - 1) orthonormal columns that sum to zero: column i is constant over
    the first i + 1 phases and balances them in the next."""
    if type(period) is not int or period < 2:
        raise ValueError("a period is an integer of at least 2")
    norm = [math.sqrt((i + 1) * (i + 2)) for i in range(period - 1)]
    return [[(1.0 if j <= i else -(i + 1.0) if j == i + 1 else 0.0) / norm[i] for i in range(period - 1)] for j in range(period)]


def contrast_table(spark: SparkSession, period: int) -> DataFrame:
    """(phase, contrast, value), made in Spark."""
    grid = spark.range(period).select(F.col("id").cast("int").alias("phase")).select("phase", F.explode(F.sequence(F.lit(0), F.lit(period - 2))).alias("contrast"))
    i, j = F.col("contrast"), F.col("phase")
    norm = F.sqrt((i + 1) * (i + 2))
    return grid.withColumn("value", F.when(j <= i, 1 / norm).when(j == i + 1, -(i + 1) / norm).otherwise(0.0))


def seasonal_sigma(sigma: Column, weights: Column, phase_: Column, period: int) -> Column:
    """sigma * exp(contrasts of the phase . weights); ``weights``: array of period - 1 numbers."""
    rows = F.array(*(F.array(*map(F.lit, row)) for row in contrasts(period)))
    log_factor = F.aggregate(F.zip_with(F.get(rows, phase_), weights, lambda c, u: c * u), F.lit(0.0), lambda a, x: a + x)
    return sigma * F.exp(log_factor)
