"""The normal family as Column expressions that stay inside whole-stage code.

Spark has no error function.  The distribution function is the rational
approximation of Hart in West's form (double precision), its inverse is Wichura's
algorithm AS 241 (16 digits).  A scale that isn't positive gives NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The published coefficients, highest power first.
CDF_OVER = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_UNDER = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
PPF_A = (2.5090809287301226727e3, 3.3430575583588128105e4, 6.7265770927008700853e4, 4.5921953931549871457e4, 1.3731693765509461125e4, 1.9715909503065514427e3, 1.3314166789178437745e2, 3.3871328727963666080e0)
PPF_B = (5.2264952788528545610e3, 2.8729085735721942674e4, 3.9307895800092710610e4, 2.1213794301586595867e4, 5.3941960214247511077e3, 6.8718700749205790830e2, 4.2313330701600911252e1, 1.0)
PPF_C = (7.74545014278341407640e-4, 2.27238449892691845833e-2, 2.41780725177450611770e-1, 1.27045825245236838258e0, 3.64784832476320460504e0, 5.76949722146069140550e0, 4.63033784615654529590e0, 1.42343711074968357734e0)
PPF_D = (1.05075007164441684324e-9, 5.47593808499534494600e-4, 1.51986665636164571966e-2, 1.48103976427480074590e-1, 6.89767334985100004550e-1, 1.67638483018380384940e0, 2.05319162663775882187e0, 1.0)
PPF_E = (2.01033439929228813265e-7, 2.71155556874348757815e-5, 1.24266094738807843860e-3, 2.65321895265761230930e-2, 2.96560571828504891230e-1, 1.78482653991729133580e0, 5.46378491116411436990e0, 6.65790464350110377720e0)
PPF_F = (2.04426310338993978564e-15, 1.42151175831644588870e-7, 1.84631831751005468180e-5, 7.86869131145613259100e-4, 1.48753612908506148525e-2, 1.36929880922735805310e-1, 5.99832206555887937690e-1, 1.0)

NAN = float("nan")


def horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def cdf0(x: Column) -> Column:
    """P(Z <= x) for a standard normal Z; far tails keep their relative precision."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    far = a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))
    upper = F.when(a > 37, 0.0).when(a < 7.07106781186547, e * horner(CDF_OVER, a) / horner(CDF_UNDER, a)).otherwise(e / far / math.sqrt(2 * math.pi))
    return F.when(F.isnan(x), NAN).when(x > 0, 1 - upper).otherwise(upper)


def ppf0(p: Column) -> Column:
    """The standard normal quantile; 0 and 1 give the infinities, other values outside NaN."""
    q = p - 0.5
    r = 0.180625 - q * q
    tail = F.sqrt(-F.log(F.least(p, 1 - p)))
    near, far = tail - 1.6, tail - 5
    out = F.when(tail <= 5, horner(PPF_C, near) / horner(PPF_D, near)).otherwise(horner(PPF_E, far) / horner(PPF_F, far))
    return (
        F.when(F.isnan(p) | (p < 0) | (p > 1), NAN).when(p == 0, -math.inf).when(p == 1, math.inf)
        .when(F.abs(q) <= 0.425, q * horner(PPF_A, r) / horner(PPF_B, r)).when(q < 0, -out).otherwise(out)
    )


def _guard(sigma: Column, value: Column) -> Column:
    return F.when(sigma > 0, value).otherwise(NAN)


def logpdf(y: Column, eta: Column, sigma: Column) -> Column:
    z = (y - eta) / sigma
    return _guard(sigma, -0.5 * math.log(2 * math.pi) - F.log(sigma) - z * z / 2)


def cdf(y: Column, eta: Column, sigma: Column) -> Column:
    return _guard(sigma, cdf0((y - eta) / sigma))


def sf(y: Column, eta: Column, sigma: Column) -> Column:
    return _guard(sigma, cdf0((eta - y) / sigma))


def ppf(p: Column, eta: Column, sigma: Column) -> Column:
    return _guard(sigma, eta + sigma * ppf0(p))


def gradient(y: Column, eta: Column, sigma: Column) -> Column:
    """Of the log density with respect to eta."""
    return _guard(sigma, (y - eta) / (sigma * sigma))


def hessian(y: Column, eta: Column, sigma: Column) -> Column:
    return _guard(sigma, -1 / (sigma * sigma))
