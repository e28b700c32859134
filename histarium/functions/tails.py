"""Tail probabilities, which Spark's own functions lack, on Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_erfc = np.vectorize(math.erfc, otypes=[float])


@pandas_udf(DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return pd.Series(_erfc(z.abs().to_numpy(float) / math.sqrt(2)))


@pandas_udf(DoubleType())
def normal_upper(z: pd.Series) -> pd.Series:
    return pd.Series(0.5 * _erfc(z.to_numpy(float) / math.sqrt(2)))


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if not 0 < x < 1:
        return float("nan") if math.isnan(x) else float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    away = lambda v: v if abs(v) > tiny else tiny
    c, d = 1.0, 1 / away(1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, 500):
        for n in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + n * d)
            c = away(1 + n / c)
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided_value(t: float, df: float) -> float:
    if math.isnan(t) or df <= 0:
        return float("nan")
    return 0.0 if math.isinf(t) else incomplete_beta(df / (df + t * t), df / 2, 0.5)


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided_value(a, b) for a, b in zip(t.astype(float), df.astype(float), strict=True)])
