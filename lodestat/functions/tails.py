"""Tail probabilities of the common distributions.

Plain numeric helpers from published formulas (Abramowitz and Stegun; Lentz
continued fractions), applied by Arrow UDFs to small result rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def normal_ppf(p: float) -> float:
    """Newton steps on the normal distribution function."""
    if not 0 < p < 1:
        return math.nan
    x = 0.0
    lo, hi = -40.0, 40.0
    for _ in range(200):
        x = (lo + hi) / 2
        if normal_cdf(x) < p:
            lo = x
        else:
            hi = x
    return x


def beta_reg(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_reg(1 - x, b, a)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(0, 10000):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + num * d, tiny, key=abs)
        c = max(1 + num / c, tiny, key=abs)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return min(1.0, front * (f - 1))


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return 1 - total * front
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 10000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def t_sf2(t: float, dof: float) -> float:
    if math.isnan(t) or dof <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    return beta_reg(dof / (dof + t * t), dof / 2, 0.5)


def f_sf(f: float, d1: float, d2: float) -> float:
    if math.isnan(f) or d1 <= 0 or d2 <= 0:
        return math.nan
    if math.isinf(f):
        return 0.0
    return beta_reg(d2 / (d2 + d1 * max(f, 0.0)), d2 / 2, d1 / 2)


def chi2_sf(x: float, dof: float) -> float:
    return math.nan if math.isnan(x) or dof <= 0 else gamma_upper(dof / 2, x / 2)


def kolmogorov_sf(lam: float) -> float:
    """Limit distribution of the Kolmogorov statistic."""
    if math.isnan(lam):
        return math.nan
    if lam < 0.2:
        return 1.0
    s = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * lam * lam) for k in range(1, 101))
    return min(1.0, max(0.0, s))


def beta_ppf(p: float, a: float, b: float) -> float:
    lo, hi = 0.0, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        if beta_reg(mid, a, b) < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def t_ppf(p: float, dof: float) -> float:
    lo, hi = -1e6, 1e6
    for _ in range(200):
        mid = (lo + hi) / 2
        cdf = 1 - t_sf2(mid, dof) / 2 if mid > 0 else t_sf2(mid, dof) / 2
        if cdf < p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def _lift(fn, *args: Column) -> Column:
    """A scalar helper as an Arrow UDF over small rows; null in, null out."""

    @F.pandas_udf("double")
    def apply(*series: pd.Series) -> pd.Series:
        frame = pd.concat([s.astype("float64") for s in series], axis=1)
        out = [np.nan if np.isnan(r).any() else fn(*r) for r in frame.to_numpy()]
        return pd.Series(out, dtype="float64").replace({np.nan: None})

    return apply(*[a.cast("double") for a in args])


def normal_two_sided(z: Column) -> Column:
    return _lift(lambda v: math.erfc(abs(v) / math.sqrt(2)), z)


def normal_below(z: Column) -> Column:
    return _lift(normal_cdf, z)


def t_two_sided(t: Column, dof: Column) -> Column:
    return _lift(t_sf2, t, dof)


def t_quantile(p: Column, dof: Column) -> Column:
    return _lift(t_ppf, p, dof)


def f_above(f: Column, d1: Column, d2: Column) -> Column:
    return _lift(f_sf, f, d1, d2)


def chi2_above(x: Column, dof: Column) -> Column:
    return _lift(chi2_sf, x, dof)


def kolmogorov_above(lam: Column) -> Column:
    return _lift(kolmogorov_sf, lam)


def beta_quantile(p: Column, a: Column, b: Column) -> Column:
    return _lift(beta_ppf, p, a, b)
