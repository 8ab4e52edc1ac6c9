"""Comparison of curve models: residual size, memory, agreement, summary."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratanet.functions.maturity import term_years
from stratanet.functions.moments import safe_corr
from stratanet.functions.tails import chi2_tail
from stratanet.operators.arbfree import ModelSpec, PanelFit, fit_panel, mean_reversion
from stratanet.operators.panel import NetworkKind
from stratanet.operators.residuals import DEFAULT_THRESHOLD, residual_networks
from stratanet.session import cut_lineage

LONG_END, SHORT_END = 15.0, 2.0
SAME_EDGES = 0.999


def expand_specs(
    models: list[str], scopes: list[str], decays: list[float | None], **common
) -> list[ModelSpec]:
    """models x scopes x decays; a model without volatility takes one scope."""
    specs = []
    for model in models:
        for scope in scopes if model != "ns" else scopes[:1]:
            for decay in decays:
                specs.append(ModelSpec(model=model, sigma_scope=scope, decay=decay, **common))
    return specs


def check_specs(specs: list[ModelSpec]) -> None:
    names = [s.name for s in specs]
    if not names:
        raise ValueError("no models to compare")
    if len(set(names)) != len(names):
        raise ValueError(f"model names repeat: {sorted(names)}")


def _stack(frames: dict[str, DataFrame]) -> DataFrame:
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("model", F.lit(name)) for name, df in frames.items()],
    )


def fit_all(
    curve: DataFrame, specs: list[ModelSpec], issuer: str = "source", date: str = "date"
) -> dict[str, PanelFit]:
    """Each model once; the curve is written once because every fit reads it."""
    check_specs(specs)
    kept = cut_lineage(curve)
    return {s.name: fit_panel(kept, s, issuer, date) for s in specs}


def stacked_residuals(fits: dict[str, PanelFit]) -> DataFrame:
    return _stack({n: f.residuals for n, f in fits.items()})


def residual_size(residuals: DataFrame) -> DataFrame:
    """(model, term): n_obs, rmse, mae."""
    r = F.col("residual")
    return residuals.groupBy("model", "term").agg(
        F.first("maturity_years").alias("maturity_years"),
        F.count(F.lit(1)).alias("n_obs"),
        F.sqrt(F.avg(r * r)).alias("rmse"),
        F.avg(F.abs(r)).alias("mae"),
    )


def series_acf(residuals: DataFrame, lags: int = 5) -> DataFrame:
    """(model, issuer, term, n, acf_1.., q, ljung_box_p); null on short or flat series."""
    by = ["model", "issuer", "term"]
    w = Window.partitionBy(*by)
    ordered = w.orderBy("date")
    centred = residuals.withColumn("_c", F.col("residual") - F.avg("residual").over(w))
    lagged = centred.withColumns(
        {f"_p{k}": F.col("_c") * F.lag("_c", k).over(ordered) for k in range(1, lags + 1)}
    )
    sums = lagged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("_c") * F.col("_c")).alias("_d"),
        *[F.coalesce(F.sum(f"_p{k}"), F.lit(0.0)).alias(f"_p{k}") for k in range(1, lags + 1)],
    )
    live = (F.col("n") >= max(3 * lags, 12)) & (F.col("_d") > 0)
    acf = sums.select(
        *by,
        "n",
        *[
            F.when(live, F.col(f"_p{k}") / F.col("_d")).alias(f"acf_{k}")
            for k in range(1, lags + 1)
        ],
    )
    n = F.col("n").cast("double")
    terms = [F.col(f"acf_{k}") * F.col(f"acf_{k}") / (n - k) for k in range(1, lags + 1)]
    q = acf.withColumn("q", n * (n + 2.0) * reduce(lambda a, b: a + b, terms))
    return q.withColumn("ljung_box_p", chi2_tail(F.col("q"), lags))


def mean_acf(acf: DataFrame, lags: int = 5) -> DataFrame:
    """(model, term): averages over issuers, undefined series left out."""
    names = [f"acf_{k}" for k in range(1, lags + 1)] + ["q", "ljung_box_p"]
    return acf.groupBy("model", "term").agg(*[F.avg(c).alias(c) for c in names])


def acf_long(acf: DataFrame, lags: int = 5) -> DataFrame:
    names = [f"acf_{k}" for k in range(1, lags + 1)]
    long = acf.select("model", "term", *names).unpivot(["model", "term"], names, "lag", "acf")
    return long.withColumn("lag", F.regexp_replace("lag", "acf_", "").cast("int"))


def in_basis_points(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c) * 1e4 for c in columns})


def fit_diagnostics(fits: dict[str, PanelFit]) -> DataFrame:
    """One row per model: volatility, errors, adjustment, scale, mean reversion."""
    rows = []
    for name, fit in fits.items():
        sigma = fit.sigma.agg(
            F.count(F.lit(1)).alias("n_issuers"),
            *[F.avg(F.sqrt(f"s{k}")).alias(f"sigma_{k}") for k in ("11", "22", "33")],
            F.median("yield_scale").alias("yield_scale"),
        )
        rmse = (
            fit.factors.groupBy("issuer")
            .agg(F.avg("rmse").alias("rmse"))
            .agg(F.avg("rmse").alias("mean_rmse"))
        )
        adj = fit.adjustment.agg(F.max(F.abs("adjustment")).alias("max_abs_adjustment"))
        passes = 0 if fit.spec.model == "ns" else max(fit.spec.n_refit, 0)
        one = sigma.withColumn("mean_rmse", rmse.scalar()).withColumn(
            "max_abs_adjustment", adj.scalar()
        )
        eig = kappa_eigenvalues(mean_reversion(fit.sigma, fit.spec.dt, "issuer")).agg(
            *[F.avg(f"e{k}").alias(f"kappa_eig_{k}") for k in (1, 2, 3)]
        )
        for k in (1, 2, 3):
            one = one.withColumn(f"kappa_eig_{k}", eig.select(f"kappa_eig_{k}").scalar())
        rows.append(
            one.withColumn("model", F.lit(name))
            .withColumn("n_iterations", F.lit(passes))
            .withColumn("sigma_converged", F.lit(True))
        )
    return reduce(DataFrame.unionByName, rows)


def kappa_eigenvalues(kappa: DataFrame) -> DataFrame:
    """(e1, e2, e3): sorted real parts per issuer; issuers without kappa are left out."""

    def run(batches):
        for pdf in batches:
            k = [np.asarray(v, dtype=float).reshape(3, 3) for v in pdf["kappa_p"] if v is not None]
            e = [np.sort(np.real(np.linalg.eigvals(m))) for m in k]
            yield pd.DataFrame(np.array(e).reshape(-1, 3), columns=["e1", "e2", "e3"])

    return kappa.select("kappa_p").mapInPandas(run, "e1 double, e2 double, e3 double")


def cell_agreement(residuals: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Residual correlation and mean absolute difference over shared cells."""
    wanted = _pair_table(residuals, pairs)
    cell = ["issuer", "date", "term"]
    a = residuals.select(*cell, F.col("model").alias("model_a"), F.col("residual").alias("a"))
    b = residuals.select(*cell, F.col("model").alias("model_b"), F.col("residual").alias("b"))
    both = a.join(wanted, "model_a").join(b, [*cell, "model_b"])
    return both.groupBy("model_a", "model_b").agg(
        safe_corr(F.col("a"), F.col("b")).alias("residual_corr"),
        F.avg(F.abs(F.col("a") - F.col("b"))).alias("mean_abs_diff"),
    )


def _pair_table(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The list of model pairs: as long as the caller's list, hence broadcast."""
    return F.broadcast(
        df.sparkSession.createDataFrame(pairs, "model_a string, model_b string")
    )


def edge_agreement(
    nodes: DataFrame, edges: DataFrame, pairs: list[tuple[str, str]]
) -> DataFrame:
    """(model_a, model_b, label): Jaccard of edge sets, null when both are empty."""
    wanted = _pair_table(nodes, pairs)
    key = ["label", "src", "dst"]
    marks = edges.select("model", *key)
    a = marks.withColumnRenamed("model", "model_a").join(wanted, "model_a")
    b = marks.withColumnRenamed("model", "model_b").join(wanted, "model_b")
    both = (
        a.withColumn("_a", F.lit(1))
        .join(b.withColumn("_b", F.lit(1)), ["model_a", "model_b", *key], "full")
        .groupBy("model_a", "model_b", "label")
        .agg(
            F.count("_a").alias("n_edges_a"),
            F.count("_b").alias("n_edges_b"),
            F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("_both"),
            F.count(F.lit(1)).alias("_any"),
        )
    )
    labels = nodes.select(F.col("model").alias("model_a"), "label").distinct()
    return (
        labels.join(wanted, "model_a")
        .join(both, ["model_a", "model_b", "label"], "left")
        .fillna(0, ["n_edges_a", "n_edges_b"])
        .select(
            "model_a", "model_b", "label",
            (F.col("_both") / F.col("_any")).alias("edge_jaccard"),
            "n_edges_a", "n_edges_b",
        )
    )


def agreement_summary(agreement: DataFrame) -> DataFrame:
    """Per model pair: Jaccard range and how many layers differ."""
    j = F.col("edge_jaccard")
    return agreement.groupBy("model_a", "model_b").agg(
        F.min(j).alias("min_jaccard"), F.avg(j).alias("mean_jaccard"),
        F.max(j).alias("max_jaccard"),
        F.count(F.when(j < SAME_EDGES, 1)).alias("n_layers_differ"),
    )


def summarize(size: DataFrame, acf: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row per model, best long end first."""
    years = term_years(F.col("term"))
    both = size.drop("maturity_years").join(acf, ["model", "term"]).withColumn("_y", years)
    rows = both.groupBy("model").agg(
        F.avg("rmse").alias("rmse_all"),
        F.avg(F.when(F.col("_y") >= LONG_END, F.col("rmse"))).alias("rmse_long"),
        F.avg(F.when(F.col("_y") <= SHORT_END, F.col("rmse"))).alias("rmse_short"),
        F.sum("n_obs").alias("n_obs"),
        F.avg(F.abs("acf_1")).alias("mean_abs_acf1"),
    )
    return rows.join(diagnostics, "model", "left").orderBy("rmse_long")


def mean_adjustment(fits: dict[str, PanelFit]) -> DataFrame:
    """(model, maturity_years, adjustment): mean over the issuers that quote it."""
    return (
        _stack({n: f.adjustment for n, f in fits.items()})
        .groupBy("model", "maturity_years")
        .agg(F.avg("adjustment").alias("adjustment"))
    )


def compare_models(
    curve: DataFrame,
    specs: list[ModelSpec],
    kind: NetworkKind = NetworkKind.ISSUER_BY_TERM,
    threshold: float = DEFAULT_THRESHOLD,
    lags: int = 5,
    issuer: str = "source",
    date: str = "date",
) -> dict[str, DataFrame]:
    """Every comparison frame, each model fitted once."""
    fits = fit_all(curve, specs, issuer, date)
    residuals = cut_lineage(stacked_residuals(fits))
    nodes, edges = residual_networks(residuals, kind, threshold, ("model",))
    edges = cut_lineage(edges)
    names = list(fits)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    size = residual_size(residuals)
    acf = mean_acf(series_acf(residuals, lags), lags)
    diagnostics = fit_diagnostics(fits)
    frames = {
        "residuals": residuals, "nodes": nodes, "edges": edges, "size": size, "acf": acf,
        "diagnostics": diagnostics, "summary": summarize(size, acf, diagnostics),
        "adjustment": mean_adjustment(fits),
    }
    if pairs:
        frames["cell_agreement"] = cell_agreement(residuals, pairs)
        frames["edge_agreement"] = edge_agreement(nodes, edges, pairs)
    return frames
