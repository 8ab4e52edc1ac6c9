"""Curve loadings and convexity shapes as column expressions.

``decay`` is a scale in years throughout: loadings decay as exp(-m / decay).
A cross-section y = level + slope f1 + curvature f2 is fitted on the basis
(1, f1, g) with g = f1 - f2, which stays well conditioned when decay is short.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MATURITY_FLOOR = 1e-6


def as_column(x: Column | float) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else x


def decay_to_rate(decay: Column | float):
    """Reciprocal; only positive decays have a rate."""
    if isinstance(decay, (int, float)):
        if not decay > 0:
            raise ValueError("decay must be positive")
        return 1.0 / decay
    return F.when(decay > 0, 1.0 / decay).otherwise(
        F.raise_error(F.lit("decay must be positive")).cast("double")
    )


rate_to_decay = decay_to_rate


def ns_loadings(years: Column, decay: Column | float) -> tuple[Column, Column]:
    """(f1, g): slope loading, and slope minus curvature loading."""
    x = F.greatest(years, F.lit(MATURITY_FLOOR)) / as_column(decay)
    g = F.exp(-x)
    return (1.0 - g) / x, g


def period_decay(decay: Column | float, dt: float) -> Column:
    return 1.0 - F.exp(-F.lit(float(dt)) / as_column(decay))


def period_bond_loadings(n: Column, decay: Column | float, dt: float):
    """(b1, b2, b3) of a discrete-time bond with n periods to run."""
    lam = period_decay(decay, dt)
    rho = 1.0 - lam
    tail = F.pow(rho, n - 1.0)
    return n, (1.0 - F.pow(rho, n)) / lam, (1.0 - tail) / lam - (n - 1.0) * tail


def discrete_loadings(years: Column, decay: Column | float, dt: float):
    """(f1, g) on a period grid; a maturity spans at least one period."""
    n = years / F.lit(float(dt))
    n = F.when(n >= 1.0, n).otherwise(
        F.raise_error(F.lit("maturity shorter than one period")).cast("double")
    )
    _b1, b2, b3 = period_bond_loadings(n, decay, dt)
    return b2 / n, (b2 - b3) / n


#: The six products of volatility rows, in the order the shapes use.
GRAM = ("s11", "s22", "s33", "s12", "s13", "s23")


def afns_shapes(years: Column, decay: Column | float) -> dict[str, Column]:
    """Yield adjustment per unit of each volatility product, with the sign dropped.

    Written in x = maturity / decay; e_k = exp(-kx), m_k its mean over (0, x).
    """
    s = as_column(decay)
    x = years / s
    e1, e2 = F.exp(-x), F.exp(-2.0 * x)
    m1, m2 = (1.0 - e1) / x, (1.0 - e2) / (2.0 * x)
    unit = s * s
    return {
        "s11": years * years / 6.0,
        "s22": unit * (0.5 - m1 + 0.5 * m2),
        "s33": unit * (0.5 + e1 - 0.25 * x * e2 - 0.75 * e2 - 2.0 * m1 + 1.25 * m2),
        "s12": unit * (0.5 * x + e1 - m1),
        "s13": unit * (3.0 * e1 + 0.5 * x + x * e1 - 3.0 * m1),
        "s23": unit * (1.0 + e1 - 0.5 * e2 - 3.0 * m1 + 1.5 * m2),
    }
