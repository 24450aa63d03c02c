"""Two-sided Student p-values as column expressions, by one formula for all degrees of freedom.

With ``w = t y + y^2 / 2`` the two tails beyond ``t`` are, for ``v`` degrees of freedom,

    p = K (1 + t^2/v)^(-v/2)  integral over y > 0 of  e^(-w) (t + y) / sqrt(1 - e^(-2w/v) / (1 + t^2/v))

with ``K = 2 G((v+1)/2) / (v sqrt(pi) G(v/2))``. The tail's size stands before the integral, whose integrand is smooth and
positive, so nothing cancels: tiny values keep their digits and none is negative. The integral is a Gauss-Legendre sum of a fixed
number of terms, and the quotient of the gamma functions an asymptotic series after a fixed number of recurrence steps, so the
work per row never grows with the data.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_NODES = 64
_REACH = 45.0  # e^-45 of the integrand is left out
_STEPS = 16


def _gamma_quotient(x: Column) -> Column:
    """G(x + 1/2) / G(x)."""
    ratio = F.lit(1.0)
    for k in range(_STEPS):
        ratio = ratio * (x + k) / (x + (k + 0.5))
    z = x + _STEPS
    series = F.lit(0.0)
    for c in (-399 / 262144, -21 / 32768, 5 / 1024, 1 / 128, -1 / 8):  # coefficients of 1/z^5 ... 1/z
        series = (series + c) / z
    return ratio * F.sqrt(z) * (1 + series)


def _integral(t: Column, df: Column, log_base: Column) -> Column:
    reach = F.sqrt(t * t + 2 * _REACH) - t
    nodes, weights = np.polynomial.legendre.leggauss(_NODES)
    table = F.array(*[F.struct(F.lit(float((n + 1) / 2)).alias("n"), F.lit(float(w / 2)).alias("w")) for n, w in zip(nodes, weights)])

    def add(total: Column, at: Column) -> Column:
        y = at["n"] * reach
        w = t * y + y * y / 2
        return total + at["w"] * F.exp(-w) * (t + y) / F.sqrt(-F.expm1(-(log_base + 2 * w / df)))

    return reach * F.aggregate(table, F.lit(0.0), add)


def two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) for a Student T with ``df`` degrees of freedom; NULL when undefined."""
    t, df = F.abs(t).cast("double"), df.cast("double")
    log_base = F.log1p(t * t / df)
    front = 2 / math.sqrt(math.pi) * _gamma_quotient(df / 2) / df
    p = F.least(front * F.exp(-df / 2 * log_base) * _integral(t, df, log_base), F.lit(1.0))
    return F.when((df < 1) | t.isNull() | df.isNull(), F.lit(None).cast("double")).when(t == math.inf, F.lit(0.0)).otherwise(p)


_NEWTON = 16


def t_quantile(level: float, df: Column) -> Column:
    """The t beyond which both tails of a Student T hold ``1 - level``; NULL when undefined.

    Newton steps on the logarithm of the tail over the logarithm of t, in which the tail is nearly a line for few degrees of
    freedom and bends evenly for many; they start from the normal quantile, and their number is fixed.
    """
    tail, df = 1 - level, df.cast("double")
    front = 2 / math.sqrt(math.pi) * _gamma_quotient(df / 2) / F.sqrt(df)  # twice the density at 0

    def step(u: Column, _: Column) -> Column:
        t = F.exp(u)
        p = two_sided_p(t, df)
        slope = front * F.exp(-(df + 1) / 2 * F.log1p(t * t / df)) * t / p
        return u + F.least(F.log(p / tail) / slope, F.lit(4.0))

    start = F.lit(math.log(NormalDist().inv_cdf(1 - tail / 2)))
    found = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(_NEWTON)), start, step))
    return F.when(df >= 1, found)
