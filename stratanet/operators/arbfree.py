"""Arbitrage-free curve models: volatility from factor dynamics, convexity, refit.

The cross-section is linear, so fitting y - a with a per-term offset ``a`` gives
factors(y) - factors(a) and residuals(y) - residuals(a).  On dense dates ``a``
does not change with the date, hence factors move by a constant, their VAR
innovations do not move at all, and the volatility of every refit pass equals
that of the first.  One pass over the panel plus a fit of the per-issuer offset
row therefore gives what repeated passes converge to.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratanet.functions.loadings import (
    GRAM,
    afns_shapes,
    discrete_loadings,
    ns_loadings,
    period_bond_loadings,
)
from stratanet.functions.maturity import canonical_term, term_years
from stratanet.operators import curvefit as C
from stratanet.operators.panel import detect_scale
from stratanet.session import cut_lineage

MIN_DATES_FOR_VAR = 12
FACTORS = ("level", "slope", "curvature")


@dataclass(frozen=True)
class ModelSpec:
    """Everything that defines one residual fit."""

    model: str = "ns"
    decay: float | None = 1.0
    estimator: str = "two_step"
    sigma_scope: str = "per_issuer"
    n_refit: int = 1
    correlated_sigma: bool = False
    dt: float = 1.0 / 252.0
    yield_scale: float | None = None

    @property
    def name(self) -> str:
        """The model, then each choice that sets it apart, joined by slashes."""
        adjusted = self.model != "ns"
        choices = (
            (adjusted, self.sigma_scope),
            (adjusted and self.estimator != "two_step", self.estimator),
            (self.decay not in (None, 1.0), f"d{self.decay or 0:g}"),
        )
        return "/".join([self.model, *(text for made, text in choices if made)])


# -- adjustment ------------------------------------------------------------------


def shape_table(terms: DataFrame, spec: ModelSpec, decay: Column) -> DataFrame:
    """(issuer, term, years, decay, u_<gram>): adjustment per unit of volatility."""
    if spec.model not in SHAPES:
        raise ValueError(f"curve model {spec.model!r} has no adjustment")
    return SHAPES[spec.model](terms, spec, decay)


def continuous_shapes(terms: DataFrame, spec: ModelSpec, decay: Column) -> DataFrame:
    shapes = afns_shapes(F.col("years"), decay)
    return terms.withColumns({f"u_{k}": v for k, v in shapes.items()})


def discrete_shapes(terms: DataFrame, spec: ModelSpec, decay: Column) -> DataFrame:
    """Sums of bond-loading products up to the horizon.

    They do not depend on the volatility, so a term's periods are summed once.
    """
    dt = spec.dt
    horizon = F.greatest(F.lit(1), F.rint(F.col("years") / dt).cast("int"))
    steps = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), horizon - 1)))
    grid = terms.withColumn("_h", horizon).withColumn("_s", steps)
    b1, b2, b3 = period_bond_loadings(F.col("_s").cast("double"), decay, dt)
    live = F.when(F.col("_h") > 1, 1.0).otherwise(0.0)
    products = {
        "s11": b1 * b1, "s22": b2 * b2, "s33": b3 * b3,
        "s12": 2.0 * b1 * b2, "s13": 2.0 * b1 * b3, "s23": 2.0 * b2 * b3,
    }
    scale = F.lit(0.5 * dt**3) / F.first("years")
    return grid.groupBy(*terms.columns).agg(
        *[(F.sum(p * live) * scale).alias(f"u_{k}") for k, p in products.items()]
    )


#: Adjustment of each model, as ``shape_table`` returns it.
SHAPES = {"afns": continuous_shapes, "dtafns": discrete_shapes}


def adjustment_column() -> Column:
    """-(sum over products of unit shape x volatility product)."""
    total = F.col(f"u_{GRAM[0]}") * F.col(GRAM[0])
    for k in GRAM[1:]:
        total = total + F.col(f"u_{k}") * F.col(k)
    return -total


# -- volatility ------------------------------------------------------------------

_NOW = ("x0", "x1", "x2")
_BEFORE = ("z0", "z1", "z2")


def var_moments(factors: DataFrame, issuer: str, date: str) -> DataFrame:
    """Means and co-moments of (factors now, factors before) per issuer."""
    w = Window.partitionBy(issuer).orderBy(date)
    rows = factors.select(
        issuer,
        *[F.col(f).alias(x) for f, x in zip(FACTORS, _NOW, strict=True)],
        *[F.lag(f).over(w).alias(z) for f, z in zip(FACTORS, _BEFORE, strict=True)],
    )
    names = _NOW + _BEFORE
    live = F.col("z0").isNotNull()
    return rows.groupBy(issuer).agg(
        F.count(F.lit(1)).alias("n_dates"),
        *[
            F.covar_pop(F.when(live, F.col(a)), F.when(live, F.col(b))).alias(f"{a}_{b}")
            for i, a in enumerate(names)
            for b in names[i:]
        ],
    )


def innovations(moments: DataFrame, issuer: str) -> DataFrame:
    """(issuer, n_dates, resid, phi): innovation products and transition, row-major."""
    schema = T.StructType(
        [
            moments.schema[issuer],
            T.StructField("n_dates", T.LongType()),
            T.StructField("resid", T.ArrayType(T.DoubleType())),
            T.StructField("phi", T.ArrayType(T.DoubleType())),
        ]
    )

    def block(row, rows, cols):
        def at(a, b):
            key = f"{a}_{b}"
            return row[key] if key in row else row[f"{b}_{a}"]

        return np.array([[at(a, b) for b in cols] for a in rows], dtype=float)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                n = row["n_dates"]
                resid = phi = None
                if n >= MIN_DATES_FOR_VAR:
                    Cxx, Cxz = block(row, _NOW, _NOW), block(row, _NOW, _BEFORE)
                    Czz = block(row, _BEFORE, _BEFORE)
                    P = np.linalg.lstsq(Czz, Cxz.T, rcond=None)[0].T
                    S = (n - 1) * (Cxx - P @ Cxz.T - Cxz @ P.T + P @ Czz @ P.T)
                    resid, phi = S.ravel().tolist(), P.ravel().tolist()
                out.append((row[issuer], n, resid, phi))
            yield pd.DataFrame(out, columns=[f.name for f in schema])

    return moments.mapInPandas(solve, schema)


def sigma_columns(correlated: bool, dof: Column, dt: float) -> dict[str, Column]:
    """Products of the rows of Sigma from summed innovation products.

    Diagonal: only the variances.  Correlated: the lower Cholesky factor
    reproduces the whole matrix, so its row products are the matrix itself;
    when the matrix is not positive definite the diagonal is used.
    """
    v = {
        k: F.element_at("resid", 3 * i + j + 1) / dof / F.lit(dt)
        for k, (i, j) in zip(GRAM, ((0, 0), (1, 1), (2, 2), (0, 1), (0, 2), (1, 2)), strict=True)
    }
    own = {k: F.greatest(v[k], F.lit(0.0)) for k in GRAM[:3]}
    if not correlated:
        return own | {k: F.lit(0.0) for k in GRAM[3:]}
    a, b, c, d, e, f = (v[k] for k in GRAM)
    det = a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)
    definite = (a > 0) & (a * b - d * d > 0) & (det > 0)
    return own | {k: F.when(definite, v[k]).otherwise(0.0) for k in GRAM[3:]}


def estimate_sigma(
    factors: DataFrame, spec: ModelSpec, issuer: str = "source", date: str = "date"
) -> DataFrame:
    """(issuer, n_dates, s11 … s23, phi); zero when there are too few dates."""
    inn = innovations(var_moments(factors, issuer, date), issuer)
    if spec.sigma_scope == "pooled":
        live = inn.where(F.col("resid").isNotNull())
        cells = [F.sum(F.element_at("resid", i + 1)) for i in range(9)]
        pooled = live.agg(
            F.sum(F.col("n_dates") - 1).alias("_rows"), F.array(*cells).alias("resid")
        )
        dof = F.greatest(F.col("_rows") - 4, F.lit(1)).cast("double")
        one = pooled.select(
            F.struct(
                *[
                    F.coalesce(c, F.lit(0.0)).alias(k)
                    for k, c in sigma_columns(spec.correlated_sigma, dof, spec.dt).items()
                ]
            )
        ).scalar()
        return inn.withColumn("_s", one).select(issuer, "n_dates", "_s.*", "phi")
    dof = F.greatest(F.col("n_dates") - 5, F.lit(1)).cast("double")
    cols = sigma_columns(spec.correlated_sigma, dof, spec.dt)
    return inn.select(
        issuer, "n_dates", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in cols.items()], "phi"
    )


def mean_reversion(sigma: DataFrame, dt: float, issuer: str = "source") -> DataFrame:
    """(issuer, kappa_p): -log(Phi)/dt row-major, null when undefined; reporting only."""
    schema = T.StructType(
        [sigma.schema[issuer], T.StructField("kappa_p", T.ArrayType(T.DoubleType()))]
    )

    def run(batches):
        for pdf in batches:
            out = []
            for who, phi in zip(pdf[issuer], pdf["phi"], strict=True):
                kappa = None
                if phi is not None:
                    with np.errstate(all="ignore"):
                        w, V = np.linalg.eig(np.asarray(phi, dtype=float).reshape(3, 3))
                        try:
                            L = (V * np.log(w.astype(complex))) @ np.linalg.inv(V)
                            K = -np.real(L) / dt
                            kappa = K.ravel().tolist() if np.isfinite(K).all() else None
                        except np.linalg.LinAlgError:
                            kappa = None
                out.append((who, kappa))
            yield pd.DataFrame(out, columns=[issuer, "kappa_p"])

    return sigma.select(issuer, "phi").mapInPandas(run, schema)


# -- fit ---------------------------------------------------------------------------


@dataclass
class PanelFit:
    """Frames of one fitted model; all lazy."""

    spec: ModelSpec
    residuals: DataFrame  # issuer, date, term, maturity_years, residual
    factors: DataFrame  # issuer, date, level, slope, curvature, rmse, decay
    sigma: DataFrame  # issuer, n_dates, s11 … s23, phi, yield_scale
    adjustment: DataFrame  # issuer, term, maturity_years, adjustment


LOADINGS = {"ns": ns_loadings, "afns": ns_loadings}


def _loadings(spec: ModelSpec):
    if spec.model == "dtafns":
        return lambda years, decay: discrete_loadings(years, decay, spec.dt)
    if spec.model in LOADINGS:
        return LOADINGS[spec.model]
    raise ValueError(f"unknown curve model {spec.model!r}")


def fit_model(
    curve: DataFrame, spec: ModelSpec, issuer: str = "source", date: str = "date"
) -> PanelFit:
    """Fit every issuer's curve under one model; dense dates, four terms or more."""
    loadings = _loadings(spec)
    kept = curve.join(C.usable_issuers(curve, issuer), issuer, "left_semi")
    kept = C.dense_rows(kept, issuer, date, "term")
    if spec.decay is None and spec.model != "ns":
        decays = C.panel_decay(kept, issuer, date, loadings).select(issuer, "decay")
        kept = kept.join(decays, issuer)
    elif spec.decay is None:
        kept = kept.join(C.search_decay(kept, [issuer, date], loadings), [issuer, date])
    else:
        kept = kept.withColumn("decay", F.lit(float(spec.decay)))
    scale = (
        F.lit(float(spec.yield_scale))
        if spec.yield_scale is not None
        else detect_scale(curve).scalar()
    )
    kept = kept.withColumn("yield_scale", scale).withColumn(
        "_y", F.col("rate") * F.col("yield_scale")
    )
    # Read by the factors, the terms and the final residuals: written once.
    fitted = cut_lineage(
        C.fit_rows(C.with_loadings(kept, F.col("decay"), loadings), [issuer, date], "_y")
    )
    seed = fitted.groupBy(issuer, date).agg(
        *[F.first(c).alias(c) for c in (*FACTORS, "rmse", "decay", "yield_scale")]
    )
    terms = fitted.select(issuer, "term", "years", "decay", "yield_scale").distinct()
    if spec.model == "ns" or spec.n_refit < 1:
        sigma = seed.groupBy(issuer).agg(F.count(F.lit(1)).alias("n_dates")).select(
            issuer, "n_dates", *[F.lit(0.0).alias(k) for k in GRAM],
            F.lit(None).cast("array<double>").alias("phi"),
        )
        offsets = terms.select(
            issuer, "term", "years", F.lit(0.0).alias("adjustment"), F.lit(0.0).alias("_r"),
            *[F.lit(0.0).alias(f"_{f}") for f in FACTORS], "yield_scale",
        )
    else:
        sigma = cut_lineage(estimate_sigma(seed, spec, issuer, date))
        shaped = shape_table(terms, spec, F.col("decay")).join(
            sigma.select(issuer, *GRAM), issuer
        )
        offsets = C.fit_rows(
            C.with_loadings(
                shaped.withColumn("adjustment", adjustment_column()), F.col("decay"), loadings
            ),
            [issuer],
            "adjustment",
        ).select(
            issuer, "term", "years", "adjustment", F.col("residual").alias("_r"),
            *[F.col(f).alias(f"_{f}") for f in FACTORS], "yield_scale",
        )
    if spec.decay is None and spec.model == "ns":
        offsets = offsets.dropDuplicates([issuer, "term"])
    back = F.col("yield_scale")
    w = Window.partitionBy(issuer, date)
    whole = fitted.drop("yield_scale").join(offsets.drop("years"), [issuer, "term"]).withColumn(
        "residual", (F.col("residual") - F.col("_r")) / back
    )
    whole = whole.withColumn(
        "rmse", F.sqrt(F.avg(F.col("residual") * F.col("residual")).over(w))
    )
    residuals = whole.select(
        F.col(issuer).alias("issuer"), F.col(date).alias("date"),
        canonical_term(F.col("term")).alias("term"),
        F.col("years").alias("maturity_years"), "residual",
    )
    factors = whole.groupBy(F.col(issuer).alias("issuer"), F.col(date).alias("date")).agg(
        *[((F.first(f) - F.first(f"_{f}")) / F.first(back)).alias(f) for f in FACTORS],
        F.first("rmse").alias("rmse"), F.first("decay").alias("decay"),
    )
    adjustment = offsets.select(
        F.col(issuer).alias("issuer"), canonical_term(F.col("term")).alias("term"),
        F.col("years").alias("maturity_years"),
        (F.col("adjustment") / back).alias("adjustment"),
    )
    sigma = sigma.withColumn("yield_scale", scale).withColumnRenamed(issuer, "issuer")
    return PanelFit(spec, residuals, factors, sigma, adjustment)


# -- registry ----------------------------------------------------------------------

MODELS = {"ns": fit_model, "afns": fit_model, "dtafns": fit_model}


def register_model(name: str, loadings, shapes=None, fit=fit_model) -> None:
    """Add a model by its loadings (years, decay) -> (f1, g) and its adjustment.

    ``shapes(terms, spec, decay)`` adds the columns of ``shape_table``. A model
    with a fit of its own may do without; the common fit can't.
    """
    if shapes is None and fit is fit_model:
        raise ValueError(f"curve model {name!r} needs its adjustment")
    LOADINGS[name] = loadings
    if shapes is not None:
        SHAPES[name] = shapes
    MODELS[name] = fit


def fit_panel(curve: DataFrame, spec: ModelSpec, issuer="source", date="date") -> PanelFit:
    if spec.model not in MODELS:
        raise ValueError(f"unknown curve model {spec.model!r}")
    if spec.estimator == "kalman":
        from stratanet.operators.statespace import fit_state_space

        return fit_state_space(curve, spec, issuer, date)
    return MODELS[spec.model](curve, spec, issuer, date)


def maturity_terms(curve: DataFrame, issuer: str = "source") -> DataFrame:
    return curve.select(issuer, "term", term_years(F.col("term")).alias("years")).distinct()
