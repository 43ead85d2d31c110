"""Tail probabilities of the t, F and chi-square distributions.

Used only on tables with one row per column pair.  The regularised incomplete
beta and gamma functions use the textbook series and continued fractions
(modified Lentz evaluation).
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# ship this module with the function, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_TINY = 1e-300
_STEPS = 50_000
_LARGE = 1e5  # from here on the incomplete gamma function is expanded in 1 / a, to about 1e-12 of its density


def _lentz(terms, limit: float) -> float:
    """Value of a continued fraction given as (a_i, b_i) pairs, first a_i = 1; nan if it does not converge."""
    f, c, d = _TINY, _TINY, 0.0
    for i, (a, b) in enumerate(terms):
        d = b + a * d
        c = b + a / c
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = c if abs(c) > _TINY else _TINY
        step = c * d
        f *= step
        if abs(step - 1.0) < 1e-15:
            return f
        if i > limit:
            break
    return math.nan


def _stirling_rest(z: float) -> float:
    """lgamma(z) without the leading terms of Stirling's formula."""
    if z < 10.0:
        return math.lgamma(z) - ((z - 0.5) * math.log(z) - z + 0.5 * math.log(2.0 * math.pi))
    w = 1.0 / (z * z)
    return (1.0 / 12.0 - w * (1.0 / 360.0 - w * (1.0 / 1260.0 - w / 1680.0))) / z


def beta_inc(a: float, b: float, x: float, y: float | None = None) -> float:
    """I_x(a, b), with y = 1 - x; nan if it does not converge."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_inc(b, a, y, x)
    # Large gammas cancel: only their ratios to Stirling's formula are taken.
    log_power = lambda u, v, p, q: p * (math.log1p(-v) + math.log1p(q / p)) if v < 0.5 else p * math.log(u * (p + q) / p)
    log_front = (
        log_power(x, y, a, b) + log_power(y, x, b, a) + 0.5 * math.log(a * b / (2.0 * math.pi * (a + b)))
        + _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b) - math.log(a)
    )
    if log_front < -745.0:
        return 0.0

    def terms():
        yield 1.0, 1.0
        m = 0
        while True:
            if m:
                yield m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), 1.0
            yield -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), 1.0
            m += 1

    return min(1.0, math.exp(log_front) * _lentz(terms(), _STEPS + 20.0 * math.sqrt(max(a, b))))


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x), the upper regularised incomplete gamma function; nan if it does not converge."""
    if x <= 0.0:
        return 1.0
    if a >= _LARGE:
        return _gamma_upper_large(a, x)
    log_front = a * math.log(x) - x - math.lgamma(a)
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while term >= total * 1e-16:  # falls faster than a geometric series once k exceeds x
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * math.exp(log_front))
    if log_front < -745.0:
        return 0.0

    def terms():
        yield 1.0, x + 1.0 - a
        i = 1
        while True:
            yield -i * (i - a), x + 2 * i + 1.0 - a
            i += 1

    return min(1.0, math.exp(log_front) * _lentz(terms(), _STEPS))


def _gamma_upper_large(a: float, x: float) -> float:
    """Uniform expansion for large a: the normal tail and two terms of its correction."""
    mu = (x - a) / a
    if abs(mu) < 1e-2:  # mu - log(1 + mu) by its series, which does not cancel
        half = sum((-1) ** k * mu**k / k for k in range(2, 12))
    else:
        half = mu - math.log1p(mu)
    eta = math.copysign(math.sqrt(max(2.0 * half, 0.0)), mu)
    if abs(eta) < 0.05:
        c0 = -1 / 3 + eta * (1 / 12 + eta * (-2 / 135 + eta * (1 / 864 + eta * (1 / 2835 - eta * 139 / 777600))))
        c1 = -1 / 540 + eta * (-1 / 288 + eta / 378)
    else:
        c0 = 1 / mu - 1 / eta
        c1 = 1 / eta**3 - 1 / mu**3 - 1 / mu**2 - 1 / (12 * mu)
    density = math.exp(-a * half) / math.sqrt(2.0 * math.pi * a)
    return min(1.0, max(0.0, 0.5 * math.erfc(eta * math.sqrt(a / 2.0)) + density * (c0 + c1 / a)))


def t_two_sided(t: float, df: float) -> float:
    t2 = t * t
    return beta_inc(df / 2.0, 0.5, df / (df + t2), t2 / (df + t2))


def f_upper(f: float, df1: float, df2: float) -> float:
    if f <= 0.0:
        return 1.0
    return beta_inc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f), df1 * f / (df2 + df1 * f))


def chi2_upper(x: float, df: float) -> float:
    return gamma_upper(df / 2.0, x / 2.0)


def p_value(test: str, statistic: float, df1: float, df2: float):
    """p of one test, or None where it is undefined or does not converge."""
    found = _p_value(test, statistic, df1, df2)
    return None if found is None or math.isnan(found) else found


def _p_value(test: str, statistic: float, df1: float, df2: float):
    if statistic is None or math.isnan(statistic) or df1 is None or math.isnan(df1):
        return None
    if test == "r":
        if df1 <= 0:
            return None
        r2 = min(1.0, statistic * statistic)
        return 0.0 if r2 >= 1.0 else t_two_sided(statistic * math.sqrt(df1 / (1.0 - r2)), df1)
    if test == "f":
        if df2 is None or math.isnan(df2) or df1 <= 0 or df2 <= 0:
            return None
        return 0.0 if math.isinf(statistic) else f_upper(statistic, df1, df2)
    if test == "chi2":
        return 1.0 if df1 <= 0 else chi2_upper(statistic, df1)
    return None


@F.pandas_udf(DoubleType())
def p_value_udf(test: pd.Series, statistic: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    found = [p_value(*row) for row in zip(test, statistic, df1, df2)]
    return pd.Series(found, dtype="float64")
