"""Tail probabilities of the normal, chi-square (1 df) and Student t laws.

Spark has none of them. They are applied to a handful of aggregated rows (one per experiment), never to units.
"""

from __future__ import annotations

import math
import sys
from statistics import NormalDist

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need not have this package installed


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularised incomplete beta function."""
    tiny, c = 1e-300, 1.0
    d = 1.0 / max(1.0 - (a + b) * x / (a + 1.0), tiny)
    value = d
    for m in range(1, 10000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + term / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"the continued fraction for {a}, {b}, {x} does not converge")


def _incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


# Degrees of freedom from which the law is taken as an expansion around the normal one.
_NEARLY_NORMAL = 1e6


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|)."""
    if df <= 0 or math.isnan(t) or math.isnan(df):
        return math.nan
    if df > _NEARLY_NORMAL:
        # The law as an expansion in 1/df around the normal one; the next term is below 1e-15 here.
        t = min(abs(t), 40.0)  # both tails are 0 in double precision from there on
        density = math.exp(-t * t / 2) / math.sqrt(2 * math.pi)
        terms = (t**3 + t) / (4 * df) + t * (3 * t**6 - 7 * t**4 - 5 * t**2 - 3) / (96 * df**2)
        return math.erfc(t / math.sqrt(2)) + 2 * density * terms
    return _incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The ``p`` quantile for ``p`` above one half, by bisection."""
    if df <= 0 or math.isnan(df):
        return math.nan
    tail, low, high = 2.0 * (1.0 - p), 0.0, 1.0
    while t_two_sided(high, df) > tail:
        high *= 2.0
    for _ in range(200):
        middle = (low + high) / 2.0
        if t_two_sided(middle, df) > tail:
            low = middle
        else:
            high = middle
    return (low + high) / 2.0


def _each(fn, *series: pd.Series) -> pd.Series:
    return pd.Series(
        [None if any(pd.isna(v) for v in row) else fn(*row) for row in zip(*series)], dtype="float64"
    )


@F.pandas_udf(T.DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return _each(lambda v: 0.5 * math.erfc(-v / math.sqrt(2.0)), x)


@F.pandas_udf(T.DoubleType())
def chi_square_tail(x: pd.Series) -> pd.Series:
    """P(X >= x) with one degree of freedom."""
    return _each(lambda v: math.erfc(math.sqrt(v / 2.0)), x)


@F.pandas_udf(T.DoubleType())
def t_tail(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(T.DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_quantile, p, df)
