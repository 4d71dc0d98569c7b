"""Upper-tail probabilities for the test statistics, as pandas UDFs over small result frames.

Incomplete beta and gamma functions by series and continued fraction (Abramowitz &
Stegun 6.5, 26.5); the survival side is evaluated directly so extreme tails keep
their relative accuracy.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F

_TINY = 1e-300
_EPS = 1e-16


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma."""
    if math.isnan(x) or a <= 0:
        return math.nan
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        for _ in range(100_000):
            k += 1
            term *= x / k
            total += term
            if term < total * _EPS:
                break
        return max(0.0, 1.0 - total * scale)
    b = x + 1 - a
    c = 1.0 / _TINY
    d = 1.0 / b
    frac = d
    for i in range(1, 100_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + an / c
        c = c if abs(c) > _TINY else _TINY
        step = d * c
        frac *= step
        if abs(step - 1) < 1e-15:
            break
    return scale * frac


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    frac = d
    for m in range(1, 100_000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1 + num / c
            c = c if abs(c) > _TINY else _TINY
            step = d * c
            frac *= step
        if abs(step - 1) < 1e-15:
            break
    return frac


def beta_i(a: float, b: float, x: float, y: float | None = None) -> float:
    """Regularised incomplete beta I_x(a,b); ``y`` may carry 1-x exactly."""
    y = 1 - x if y is None else y
    if math.isnan(x):
        return math.nan
    if x <= 0:
        return 0.0
    if y <= 0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
                     + a * math.log(x) + b * math.log(y))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, y) / b


def chi2_tail(x: float, dof: float) -> float:
    return gamma_q(dof / 2, x / 2)


def f_tail(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    if f <= 0:
        return 1.0
    if math.isinf(f):
        return 0.0
    return beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f), d1 * f / (d2 + d1 * f))


def t_two_sided(t: float, dof: float) -> float:
    return f_tail(t * t, 1.0, dof)


def z_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _none(v) -> bool:
    return v is None or (isinstance(v, float) and math.isnan(v))


def _lift(fn):
    def run(*cols: pd.Series) -> pd.Series:
        out = [None if any(_none(v) for v in row) else fn(*map(float, row)) for row in zip(*cols)]
        return pd.Series(out, dtype="float64")
    return run


def p_chi2(stat: Column, dof: Column) -> Column:
    def one(x: pd.Series, d: pd.Series) -> pd.Series:
        return _lift(chi2_tail)(x, d)
    return F.pandas_udf(one, "double")(stat.cast("double"), dof.cast("double"))


def p_f(stat: Column, d1: Column, d2: Column) -> Column:
    def one(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return _lift(f_tail)(x, a, b)
    return F.pandas_udf(one, "double")(stat.cast("double"), d1.cast("double"), d2.cast("double"))


def p_t(stat: Column, dof: Column) -> Column:
    def one(x: pd.Series, d: pd.Series) -> pd.Series:
        return _lift(t_two_sided)(x, d)
    return F.pandas_udf(one, "double")(stat.cast("double"), dof.cast("double"))


def p_z(stat: Column) -> Column:
    def one(x: pd.Series) -> pd.Series:
        return _lift(z_two_sided)(x)
    return F.pandas_udf(one, "double")(stat.cast("double"))
