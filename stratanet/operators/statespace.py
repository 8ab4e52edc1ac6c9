"""Kalman likelihood of arbitrage-free models over a grid of parameters.

Each (issuer, grid cell) is a group of one issuer's curves; the filter runs over
its dates.  The grid surrounds the two-step estimate and contains it, so the
chosen cell is never less likely than the seed.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratanet.functions.loadings import GRAM
from stratanet.operators import arbfree as AF
from stratanet.operators import curvefit as C
from stratanet.operators.arbfree import ModelSpec, PanelFit
from stratanet.session import cut_lineage

# Admissible ranges, starting reversion, volatility without a VAR.
KAPPA_RANGE = (1e-4, 20.0)
MEASUREMENT_FLOOR = 1e-6
START_KAPPA = (0.2, 0.5, 0.9)
START_SIGMA = (0.005, 0.010, 0.020)
JITTER = 1e-12
GRID = tuple(product((0.5, 1.0, 2.0), repeat=3))
SEED_CELL = GRID.index((1.0, 1.0, 1.0))


def transition(kappa: np.ndarray, gram: np.ndarray, dt: float):
    """Exact discretisation of a diagonal mean-reverting process."""
    rates = kappa[:, None] + kappa[None, :]
    return np.exp(-kappa * dt), gram * -np.expm1(-rates * dt) / rates, gram / rates


def run_filter(Y, B, adjustment, kappa, theta, gram, noise, dt):
    """(log-likelihood, states, residuals) of one issuer's dates in order."""
    decay, Q, P = transition(kappa, gram, dt)
    n, m = Y.shape
    R = np.eye(m) * (noise**2 + JITTER)
    x = theta.copy()
    total = 0.0
    states, residuals = np.empty((n, 3)), np.empty((n, m))
    for t in range(n):
        x = theta + decay * (x - theta)
        P = decay[:, None] * P * decay[None, :] + Q
        miss = Y[t] - B @ x - adjustment
        S = B @ P @ B.T + R
        sign, logdet = np.linalg.slogdet(S)
        if sign <= 0:
            return -np.inf, states, residuals
        K = np.linalg.solve(S, B @ P).T
        total -= 0.5 * (m * np.log(2 * np.pi) + logdet + miss @ np.linalg.solve(S, miss))
        x = x + K @ miss
        P = P - K @ B @ P
        P = 0.5 * (P + P.T)
        states[t], residuals[t] = x, Y[t] - B @ x - adjustment
    return float(total), states, residuals


def seed_parameters(curve: DataFrame, spec: ModelSpec, issuer="source", date="date") -> DataFrame:
    """Rows (issuer, date, term, y, f1, f2, shapes, seed parameters …) of dense dates."""
    two = AF.fit_model(curve, spec, issuer, date)
    kappa = AF.mean_reversion(two.sigma, spec.dt, "issuer")
    own = two.factors.groupBy("issuer").agg(
        F.count(F.lit(1)).alias("n_dates"),
        *[F.avg(f).alias(f"theta_{f}") for f in AF.FACTORS],
        F.avg("rmse").alias("noise"),
        F.first("decay").alias("decay"),
    )
    loadings = AF._loadings(spec)
    terms = two.adjustment.select("issuer", "term", F.col("maturity_years").alias("years"))
    terms = terms.join(own.select("issuer", "decay"), "issuer")
    shaped = C.with_loadings(AF.shape_table(terms, spec, F.col("decay")), F.col("decay"), loadings)
    n_terms = terms.groupBy("issuer").agg(F.count(F.lit(1)).alias("n_terms"))
    wide = (
        own.drop("decay")
        .join(two.sigma.select("issuer", *GRAM, "yield_scale"), "issuer")
        .join(kappa, "issuer", "left")
        .join(n_terms, "issuer")
    )
    observed = two.residuals.select("issuer", "date", "term").join(
        curve.select(
            F.col(issuer).alias("issuer"), F.col(date).alias("date"),
            AF.canonical_term(F.col("term")).alias("term"), "rate",
        ),
        ["issuer", "date", "term"],
    )
    return (
        observed.join(shaped, ["issuer", "term"])
        .join(wide, "issuer")
        .withColumn("y", F.col("rate") * F.col("yield_scale"))
        .withColumn("dt", F.lit(float(spec.dt)))
        .withColumn("sigma_held", F.lit(spec.sigma_scope == "pooled"))
    )


def _problem(pdf: pd.DataFrame, cell: int):
    first = pdf.iloc[0]
    terms = pdf.drop_duplicates("term").sort_values("years")
    at = {t: i for i, t in enumerate(terms["term"])}
    dates = np.sort(pdf["date"].unique())
    when = {v: i for i, v in enumerate(dates)}
    Y = np.empty((len(dates), len(at)))
    Y[pdf["date"].map(when), pdf["term"].map(at)] = pdf["y"]
    B = np.column_stack([np.ones(len(at)), terms["f1"], terms["f1"] - terms["g"]])
    k, s, e = GRID[cell]
    kappa = np.array(START_KAPPA)
    if first["kappa_p"] is not None:
        K = np.abs(np.diag(np.asarray(first["kappa_p"], dtype=float).reshape(3, 3)))
        kappa = np.clip(K, *KAPPA_RANGE)
    g = {c: float(first[c]) for c in GRAM}
    if not any(g.values()):
        g = dict(zip(GRAM, [v * v for v in START_SIGMA] + [0.0] * 3, strict=True))
    gram = np.array(
        [[g["s11"], g["s12"], g["s13"]], [g["s12"], g["s22"], g["s23"]], [g["s13"], g["s23"], g["s33"]]]
    )
    adjustment = -sum(terms[f"u_{c}"].to_numpy() * g[c] for c in GRAM) * s * s
    theta = first[[f"theta_{f}" for f in AF.FACTORS]].to_numpy(dtype=float) * first["yield_scale"]
    noise = max(float(first["noise"]) * first["yield_scale"], MEASUREMENT_FLOOR)
    params = (np.clip(kappa * k, *KAPPA_RANGE), theta, gram * s * s, noise * e, float(first["dt"]))
    return Y, B, adjustment, params, dates, list(terms["term"]), list(terms["years"])


def filter_cells(seeded: DataFrame) -> DataFrame:
    """(issuer, cell, loglik) for the grid; an issuer's rows meet once, and all cells run on them.

    A pooled volatility is held: only cells that leave it as it is are tried.
    """
    rows = seeded.where(F.col("n_dates") >= 3 * F.col("n_terms"))

    def run(key, pdf):
        held = bool(pdf["sigma_held"].iloc[0])
        cells = [c for c, (_, s, _) in enumerate(GRID) if s == 1.0 or not held]
        found = [run_filter(*(problem := _problem(pdf, c))[:3], *problem[3])[0] for c in cells]
        return pd.DataFrame({"issuer": key[0], "cell": cells, "loglik": found})

    schema = T.StructType(
        [seeded.schema["issuer"], T.StructField("cell", T.IntegerType()), T.StructField("loglik", T.DoubleType())]
    )
    return rows.groupBy("issuer").applyInPandas(run, schema)


def choose_parameters(curve: DataFrame, spec: ModelSpec, issuer="source", date="date") -> DataFrame:
    """(issuer, estimator, cell, loglik, seed_loglik); too short a history keeps two-step."""
    seeded = cut_lineage(seed_parameters(curve, spec, issuer, date))
    return choice(seeded)


def choice(seeded: DataFrame) -> DataFrame:
    scored = filter_cells(seeded)
    finite = scored.where((F.col("loglik") > float("-inf")) & ~F.isnan("loglik"))
    best = finite.groupBy("issuer").agg(
        F.max(F.struct("loglik", (-F.col("cell")).alias("_c"))).alias("_b"),
        F.max(F.when(F.col("cell") == SEED_CELL, F.col("loglik"))).alias("seed_loglik"),
    )
    who = seeded.select("issuer").distinct()
    found = best.select(
        "issuer", (-F.col("_b._c")).alias("cell"), F.col("_b.loglik").alias("loglik"), "seed_loglik"
    )
    estimator = F.when(F.col("cell").isNull(), "two_step_fallback").otherwise("kalman")
    return who.join(found, "issuer", "left").withColumn("estimator", estimator)


def fit_state_space(curve: DataFrame, spec: ModelSpec, issuer="source", date="date") -> PanelFit:
    """Filtered factors and residuals at the chosen cell; fallback issuers keep two-step."""
    two = AF.fit_model(curve, spec, issuer, date)
    seeded = cut_lineage(seed_parameters(curve, spec, issuer, date))
    picked = cut_lineage(
        choice(seeded).where(F.col("cell").isNotNull()).select("issuer", "cell")
    )
    schema = T.StructType(
        [
            seeded.schema["issuer"], seeded.schema["date"], T.StructField("term", T.StringType()),
            *[T.StructField(c, T.DoubleType()) for c in ("maturity_years", "residual", *AF.FACTORS)],
        ]
    )

    def run(key, pdf):
        Y, B, adj, params, dates, terms, years = _problem(pdf, int(pdf["cell"].iloc[0]))
        _, X, E = run_filter(Y, B, adj, *params)
        scale = float(pdf["yield_scale"].iloc[0])
        n, m = E.shape
        out = pd.DataFrame(
            {
                "issuer": key[0], "date": np.repeat(dates, m), "term": terms * n,
                "maturity_years": years * n, "residual": E.ravel() / scale,
            }
        )
        for c, f in enumerate(AF.FACTORS):
            out[f] = np.repeat(X[:, c], m) / scale
        return out

    filtered = seeded.join(picked, "issuer").groupBy("issuer").applyInPandas(run, schema)
    w = Window.partitionBy("issuer", "date")
    filtered = filtered.withColumn(
        "rmse", F.sqrt(F.avg(F.col("residual") * F.col("residual")).over(w))
    )
    columns = ["issuer", "date", "term", "maturity_years", "residual"]
    left = two.residuals.join(picked, "issuer", "left_anti").select(*columns)
    factors = filtered.groupBy("issuer", "date").agg(
        *[F.first(f).alias(f) for f in (*AF.FACTORS, "rmse")]
    )
    old = two.factors.drop("decay").join(picked, "issuer", "left_anti")
    return PanelFit(
        spec,
        filtered.select(*columns).unionByName(left),
        factors.unionByName(old).withColumn("decay", F.lit(spec.decay)),
        two.sigma,
        two.adjustment,
    )
