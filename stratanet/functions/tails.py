"""Chi-square upper tail for whole degrees of freedom, as a vectorised function."""

from __future__ import annotations

from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def chi2_tail_series(x: np.ndarray, df: int) -> np.ndarray:
    """Finite series: Poisson sum for even df, error function plus a sum for odd."""
    half = np.asarray(x, dtype=float) / 2.0
    if df % 2 == 0:
        term, total = np.ones_like(half), np.ones_like(half)
        for k in range(1, df // 2):
            term = term * half / k
            total = total + term
        return np.exp(-half) * total
    out = np.array([erfc(np.sqrt(h)) if h == h else np.nan for h in half])
    term = np.exp(-half) * np.sqrt(half) / np.sqrt(np.pi) * 2.0
    for k in range(1, (df + 1) // 2):
        out = out + term
        term = term * half / (k + 0.5)
    return out


def chi2_tail(statistic, df: int):
    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return pd.Series(chi2_tail_series(x.to_numpy(), df))

    return tail(statistic)
