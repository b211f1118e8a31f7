"""Reproducible noise: numbers that depend on named keys only.

A retried or speculative task, another number of partitions or another engine
layout gives the same numbers, as they are hashes of (seed, keys)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions import normal


def uniform(seed: int, *keys: Column) -> Column:
    """In (0, 1), never an end."""
    h = F.xxhash64(F.lit(seed).cast("long"), *keys)
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * 2.0**-53


def gaussian(seed: int, *keys: Column) -> Column:
    """The uniform number is bound once: the inverse names it some thirty times."""
    return F.element_at(F.transform(F.array(uniform(seed, *keys)), normal.ppf0), 1)


def gamma_integer(shape: int, seed: int, *keys: Column) -> Column:
    """Gamma with a whole shape: minus the sum of so many logarithms of uniforms."""
    out = F.lit(0.0)
    for i in range(shape):
        out = out - F.log(uniform(seed, *keys, F.lit(i)))
    return out


#: Tries of a rejection sampler; one is refused with a chance below 0.05 each time.
TRIES = 32


def gamma(shape: float, seed: int, *keys: Column) -> Column:
    """Gamma(shape, 1) of any positive shape by rejection (Marsaglia and Tsang), a fold over tries with keys of their own.

    Below one it is a gamma of shape + 1 times a power of a uniform."""
    if not shape > 0:
        raise ValueError("a gamma needs a positive shape")
    if shape < 1:
        return gamma(shape + 1, seed, *keys) * F.pow(uniform(seed, *keys, F.lit("below one")), F.lit(1 / shape))
    d = shape - 1 / 3
    c = 1 / (9 * d) ** 0.5

    def attempt(found: Column, i: Column) -> Column:
        def judged(x: Column) -> Column:
            v = (1 + c * x) * (1 + c * x) * (1 + c * x)
            fits = (v > 0) & (F.log(uniform(seed, *keys, i, F.lit("accept"))) < 0.5 * x * x + d - d * v + d * F.log(v))
            return F.when(fits, d * v)

        x = gaussian(seed, *keys, i, F.lit("try"))
        return F.coalesce(found, F.element_at(F.transform(F.array(x), judged), 1))

    # after all tries the mode stands in: a chance of 0.05 to the power of TRIES
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), attempt), F.lit(d))
