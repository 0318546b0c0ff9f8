"""Upper-tail p-values as Arrow UDFs (F for ANOVA, t for Pearson r).

Both reduce to the regularised incomplete beta function I_x(a, b), taken from
its continued fraction (DLMF 8.17.22) by forward recurrence of the fraction's
convergents, on the side of the mean where it converges fast.  The work grows
with the square root of the degrees of freedom; a fraction that does not
settle raises instead of giving a wrong value.  ``1 - cdf`` would underflow
to 0 for the tiny p-values of large F; the fraction keeps them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

STIRLING_FROM = 15.0
MOST_TERMS = 50_000_000


def _stirling_rest(z: float) -> float:
    """lgamma(z) minus Stirling's leading terms (DLMF 5.11.1), for large z."""
    w = 1.0 / (z * z)
    return (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w / 1188)))) / z


def _log_front(a: float, b: float, x: float) -> float:
    """log of x^a (1-x)^b / B(a, b), without cancellation for large a and b."""
    if min(a, b) < STIRLING_FROM:
        return math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    s = a + b
    drift = x * b - (1 - x) * a
    return (a * math.log1p(drift / a) + b * math.log1p(-drift / b) + 0.5 * math.log(a * b / (2 * math.pi * s))
            + _stirling_rest(s) - _stirling_rest(a) - _stirling_rest(b))


def _fraction(a: float, b: float, x: float) -> float:
    """1 / (1 + d1 / (1 + d2 / (1 + ...))) with the coefficients of DLMF 8.17.23."""
    p0, q0, p1, q1 = 0.0, 1.0, 1.0, 1.0  # numerators and denominators of two convergents
    was, k = 1.0, 0
    while k < MOST_TERMS:
        k += 1
        m = k // 2
        if k % 2:
            d = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        else:
            d = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        p0, p1 = p1, p1 + d * p0
        q0, q1 = q1, q1 + d * q0
        if q1:
            p0, q0, p1, q1 = p0 / q1, q0 / q1, p1 / q1, 1.0
            if not k % 2 and abs(p1 - was) <= 4e-16 * abs(p1):
                return p1
            if not k % 2:
                was = p1
    raise ArithmeticError(f"incomplete beta does not settle for a={a}, b={b}, x={x}")


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x <= a / (a + b):
        return math.exp(_log_front(a, b, x)) * _fraction(a, b, x) / a
    return 1.0 - math.exp(_log_front(b, a, 1.0 - x)) * _fraction(b, a, 1.0 - x) / b


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F > f) for F(d1, d2)."""
    if f is None or d1 is None or d2 is None or np.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def r_sf(r: float, n: float) -> float:
    """Two-sided p of Pearson r with n pairs."""
    if r is None or n is None or np.isnan(r) or n < 3:
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    return betainc(n / 2.0 - 1.0, 0.5, 1.0 - r * r)


@F.pandas_udf(DoubleType())
def f_pvalue(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_sf(a, b, c) for a, b, c in zip(f, d1, d2)], dtype="float64")


@F.pandas_udf(DoubleType())
def r_pvalue(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([r_sf(a, b) for a, b in zip(r, n)], dtype="float64")


def stars(p):
    """Significance label (B13) as a column expression."""
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(""))
