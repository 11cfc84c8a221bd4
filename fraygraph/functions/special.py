"""Special functions on rows that are already aggregated (a row per test, group or run), as Arrow-batched UDFs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_inverse(p: float, df: float) -> float:
    """Quantile for p > 0.5 by bisection on the tail."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) / 2 > 1 - p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        if t_two_sided(middle, df) / 2 > 1 - p:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def log10_normal_upper(z: float) -> float:
    """log10 of the upper normal tail, by its asymptotic series where the tail itself underflows."""
    tail = normal_upper(z)
    if tail > 1e-300:
        return math.log10(tail)
    series = 1 - 1 / z**2 + 3 / z**4 - 15 / z**6
    return (-z * z / 2 - math.log(z) - 0.5 * math.log(2 * math.pi) + math.log(series)) / math.log(10)


def _column(function):
    @F.pandas_udf(T.DoubleType())
    def one(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else function(float(v))).astype("float64")

    return one


def _column2(function):
    @F.pandas_udf(T.DoubleType())
    def two(x: pd.Series, y: pd.Series) -> pd.Series:
        values = [None if pd.isna(a) or pd.isna(b) or b <= 0 else function(float(a), float(b)) for a, b in zip(x, y)]
        return pd.Series(values, dtype="float64")

    return two


normal_tail = _column(normal_upper)
log10_normal_tail = _column(log10_normal_upper)
t_quantile = _column2(t_inverse)
t_tail_two_sided = _column2(t_two_sided)
