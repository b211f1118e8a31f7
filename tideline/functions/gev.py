"""The generalized extreme value family as Column expressions.

``tail`` is ``upper`` for block maxima and ``lower`` for minima (the negative of an
upper one).  ``xi`` is the shape of extreme value theory: below zero, maxima have a
finite upper end.  Outside the support the density is 0, its log -Infinity, the
distribution function 0 or 1, and derivatives are NaN.  Spark's logarithms give
null where others give -Infinity, so each is guarded.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def _sign(tail: str) -> int:
    if tail not in ("upper", "lower"):
        raise ValueError(f"tail must be upper or lower, not {tail!r}")
    return 1 if tail == "upper" else -1


def _z(y: Column, eta: Column, sigma: Column, tail: str) -> Column:
    return (y - eta) * float(_sign(tail)) / sigma


def _not_zero(xi: Column) -> Column:
    """For the branch that zero doesn't take, but that may be folded."""
    return F.when(xi == 0, 1.0).otherwise(xi)


def _log_p(z: Column, xi: Column) -> Column:
    """log of the exceedance rate p, inside the support."""
    return F.when(xi == 0, -z).otherwise(-F.log1p(xi * z) / _not_zero(xi))


def logpdf(y: Column, eta: Column, sigma: Column, xi: Column, tail: str = "upper") -> Column:
    z = _z(y, eta, sigma, tail)
    a = _log_p(z, xi)
    inside = -F.log(sigma) + (1 + xi) * a - F.exp(a)
    return F.when(~(sigma > 0), NAN).when(1 + xi * z <= 0, -math.inf).otherwise(inside)


def _below(y: Column, eta: Column, sigma: Column, xi: Column, tail: str, upper: bool) -> Column:
    """P(X <= x) or P(X > x) of the upper form X = sY."""
    z = _z(y, eta, sigma, tail)
    p = F.exp(_log_p(z, xi))
    value = -F.expm1(-p) if upper else F.exp(-p)
    beyond = F.when(xi < 0, 0.0 if upper else 1.0).otherwise(1.0 if upper else 0.0)
    return F.when(~(sigma > 0), NAN).when(1 + xi * z <= 0, beyond).otherwise(value)


def cdf(y: Column, eta: Column, sigma: Column, xi: Column, tail: str = "upper") -> Column:
    return _below(y, eta, sigma, xi, tail, upper=_sign(tail) < 0)


def sf(y: Column, eta: Column, sigma: Column, xi: Column, tail: str = "upper") -> Column:
    return _below(y, eta, sigma, xi, tail, upper=_sign(tail) > 0)


def ppf(p: Column, eta: Column, sigma: Column, xi: Column, tail: str = "upper") -> Column:
    s = _sign(tail)
    rate = -F.log(p) if s > 0 else -F.log1p(-p)  # of the upper form's exceedance
    w = F.log(rate)
    x = F.when(xi == 0, -w).otherwise(F.expm1(-xi * w) / _not_zero(xi))
    return F.when((sigma > 0) & (p > 0) & (p < 1), s * (s * eta + sigma * x)).otherwise(NAN)


def _derivative(y: Column, eta: Column, sigma: Column, xi: Column, tail: str, second: bool) -> Column:
    z = _z(y, eta, sigma, tail)
    t, p = 1 + xi * z, F.exp(_log_p(z, xi))
    value = (1 + xi) * (xi - p) / (sigma * t * sigma * t) if second else _sign(tail) * (1 + xi - p) / (sigma * t)
    return F.when((sigma > 0) & (t > 0), value).otherwise(NAN)


def gradient(y: Column, eta: Column, sigma: Column, xi: Column, tail: str = "upper") -> Column:
    """Of the log density with respect to eta."""
    return _derivative(y, eta, sigma, xi, tail, second=False)


def hessian(y: Column, eta: Column, sigma: Column, xi: Column, tail: str = "upper") -> Column:
    return _derivative(y, eta, sigma, xi, tail, second=True)


def pseudo_observation(y: Column, eta: Column, sigma: Column, xi: Column, tail: str = "upper", floor: float = 1e-6, largest: float = 1e8) -> tuple[Column, Column]:
    """(value, variance) of the normal observation with the log density's slope and curvature at eta:
    the curvature is at least ``floor``, the variance at most ``largest``, the shift at most 10 sigma."""
    information = F.greatest(-hessian(y, eta, sigma, xi, tail), F.lit(floor))
    variance = F.least(1 / information, F.lit(largest))
    shift = gradient(y, eta, sigma, xi, tail) * variance
    return eta + F.greatest(F.least(shift, 10 * sigma), -10 * sigma), variance
