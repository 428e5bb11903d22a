"""Tail probabilities as vectorised pandas UDFs (no SciPy)."""

from __future__ import annotations

from math import erfc, lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _beta_fraction(a, b, x, rounds=300):
    """Continued fraction of the incomplete beta function (Lentz's method), elementwise."""
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    h = d.copy()
    for m in range(1, rounds):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        h = h * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        h = h * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return h


def incomplete_beta(a, b, x):
    """Regularised incomplete beta function I_x(a, b), elementwise."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    a, b, x = np.broadcast_arrays(a, b, x)
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    inner = ok & (x > 0) & (x < 1)
    if inner.any():
        ai, bi, xi = a[inner], b[inner], x[inner]
        log_gamma = np.vectorize(lgamma)
        front = np.exp(
            log_gamma(ai + bi) - log_gamma(ai) - log_gamma(bi) + ai * np.log(xi) + bi * np.log1p(-xi)
        )
        direct = xi < (ai + 1.0) / (ai + bi + 2.0)
        with np.errstate(all="ignore"):
            low = front * _beta_fraction(ai, bi, xi) / ai
            high = 1.0 - front * _beta_fraction(bi, ai, 1.0 - xi) / bi
        out[inner] = np.where(direct, low, high)
    return out


@F.pandas_udf(DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: erfc(abs(v) / 2**0.5), na_action="ignore").astype(float)


@F.pandas_udf(DoubleType())
def _student_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    t, df = t.astype(float).to_numpy(), df.astype(float).to_numpy()
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    return pd.Series(incomplete_beta(df / 2.0, np.full_like(df, 0.5), x))


@F.pandas_udf(DoubleType())
def _f_upper(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    f, df1, df2 = (v.astype(float).to_numpy() for v in (f, df1, df2))
    with np.errstate(all="ignore"):
        x = np.where(np.isinf(f), 0.0, df2 / (df2 + df1 * np.maximum(f, 0.0)))
    return pd.Series(incomplete_beta(df2 / 2.0, df1 / 2.0, x))


def tail_p(kind: str, statistic: Column, *degrees: Column) -> Column:
    """Two-sided normal or Student tail, or upper F tail; null for a null or undefined statistic."""
    functions = {"normal": _normal_two_sided, "t": _student_two_sided, "f": _f_upper}
    p = functions[kind](statistic.cast("double"), *[d.cast("double") for d in degrees])
    return F.when(p.isNull() | F.isnan(p), F.lit(None).cast("double")).otherwise(p)
