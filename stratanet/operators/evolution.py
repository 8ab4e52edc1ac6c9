"""Windowed networks, factors and stress; windows are a key, never a loop."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratanet.operators import curvefit as C
from stratanet.operators import graph as G
from stratanet.operators import metrics as H
from stratanet.operators import windows as W
from stratanet.operators.pairs import Roles, complete_dates, measure_pairs
from stratanet.operators.panel import apply_transforms, daily_returns
from stratanet.operators.windows import Schedule
from stratanet.session import cut_lineage

# Regime cut on the slope, stress band, significant correlation.
REGIME_SLOPE = 0.5
STRESS_BAND = 50.0
SIGNIFICANT = 0.5

MARKET = "__market__"


# -- networks per window ---------------------------------------------------------


def evolution_graphs(
    panel: DataFrame, s: Schedule, measure: str = "pearson_correlation",
    threshold: float = G.DEFAULT_THRESHOLD, min_nodes: int = 5, roles: Roles = Roles(()),
    **settings,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) keyed by (window_idx, *keys) over already transformed rows.

    A node needs three values in a window, a window ``min_nodes`` nodes.
    """
    bounded = cut_lineage(W.bounded_rows(panel, roles.date, s))
    keys = ["window_idx", *roles.keys]
    nodes = W.window_node_counts(bounded, roles).where(F.col("n") >= 3)
    big = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_nodes)
    nodes = cut_lineage(nodes.join(big, keys, "left_semi").select(*keys, "node"))
    pairs = W.windowed_measure(bounded, measure, roles, **settings)
    # A pair with three common dates has two nodes with three values each; a
    # non-positive threshold could admit others, hence the joins on nodes.
    edges = G.threshold_edges(pairs, threshold, tuple(keys))
    for end in ("src", "dst"):
        edges = edges.join(nodes.withColumnRenamed("node", end), [*keys, end], "left_semi")
    return nodes, cut_lineage(edges)


def in_window_rows(
    panel: DataFrame, s: Schedule, transforms: list[str], roles: Roles = Roles()
) -> DataFrame:
    """Rows per window with transforms applied *inside* the window.

    For returns the previous observation must lie in the window too, which
    only lowers the last window of a row; nothing is sorted per window.
    """
    keys = ("window_idx", *roles.keys)
    inside = Roles(keys, roles.node, roles.date, roles.value)
    if list(transforms) == ["daily_returns"] and not s.expanding:
        index = W.date_index(panel, roles.date)
        before = Window.partitionBy(*roles.keys, roles.node).orderBy(roles.date)
        rows = W.bounded_rows(panel, roles.date, s, index=index)
        earlier = panel.join(index, roles.date).select(
            *roles.keys, roles.node, roles.date, F.lag("t").over(before).alias("_t0")
        )
        moved = daily_returns(panel, roles).join(
            earlier, [*roles.keys, roles.node, roles.date]
        )
        bounds = rows.select(*roles.keys, roles.node, roles.date, "k_min", "k_max")
        placed = moved.join(bounds, [*roles.keys, roles.node, roles.date])
        last = F.least("k_max", F.floor(F.col("_t0") / s.step).cast("bigint"))
        return W.spread(
            placed.withColumn("k_max", last).where(F.col("k_min") <= F.col("k_max")).drop("_t0")
        )
    spread = W.assign_windows(panel, roles.date, s)
    return apply_transforms(spread, transforms, inside)


def multiplex_evolution(
    panel: DataFrame, s: Schedule, measure: str = "pearson_correlation",
    threshold: float = G.DEFAULT_THRESHOLD, transforms: tuple[str, ...] = ("daily_returns",),
    roles: Roles = Roles(), **settings,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edge mix per window, nodes, edges); windows with one layer are left out."""
    panel = cut_lineage(panel)
    rows = cut_lineage(in_window_rows(panel, s, list(transforms), roles))
    keys = ("window_idx", "layer")
    inside = Roles(keys, roles.node, roles.date, roles.value)
    raw = W.bounded_rows(panel, roles.date, s).select(*roles.keys, "k_min", "k_max").distinct()
    layered = (
        W.spread(raw).distinct().groupBy("window_idx").agg(F.count(F.lit(1)).alias("_l"))
        .where(F.col("_l") >= 2).select("window_idx")
    )
    nodes = G.graph_nodes(rows, inside).join(layered, "window_idx", "left_semi")
    pairs = measure_pairs(rows, measure, inside, stored=True, **settings)
    edges = G.threshold_edges(pairs, threshold, keys)
    edges = cut_lineage(edges.join(nodes.select(*keys).distinct(), list(keys), "left_semi"))
    mix = edge_mix(nodes, edges, layered)
    index = W.date_index(panel, roles.date)
    windows = W.window_table(index, roles.date, s)
    return windows.join(mix, "window_idx"), nodes, edges


def edge_mix(nodes: DataFrame, edges: DataFrame, windows: DataFrame) -> DataFrame:
    """Intra and inter edges, vertices and shares per window.

    A node in c layers has c(c-1)/2 inter edges, so they are counted, not built.
    """
    intra = edges.groupBy("window_idx").agg(F.count(F.lit(1)).alias("intra_edges"))
    per_node = nodes.groupBy("window_idx", "node").agg(F.count(F.lit(1)).alias("c"))
    vertices = per_node.groupBy("window_idx").agg(
        F.sum(F.col("c") * (F.col("c") - 1) / 2).cast("bigint").alias("inter_edges"),
        F.sum("c").alias("n_nodes"),
    )
    mix = (
        windows.join(intra, "window_idx", "left").join(vertices, "window_idx", "left")
        .fillna(0, ["intra_edges", "inter_edges", "n_nodes"])
        .withColumn("total_edges", F.col("intra_edges") + F.col("inter_edges"))
    )
    share = {
        f"pct_{k}": F.when(
            F.col("total_edges") > 0, 100.0 * F.col(f"{k}_edges") / F.col("total_edges")
        )
        for k in ("intra", "inter")
    }
    return mix.withColumns(share)


def variable_nodes(
    metrics: DataFrame, metric: str, k: int = 10, by: tuple[str, ...] = (), most: bool = True
) -> DataFrame:
    """The k nodes whose metric varies most (or least) over windows, with rank."""
    spread = (
        metrics.where(F.col("metric") == metric)
        .groupBy(*by, "node")
        .agg(F.stddev_samp("value").alias("std"))
        .where(F.col("std").isNotNull())
    )
    order = [F.col("std").desc() if most else F.col("std").asc(), F.col("node").asc()]
    if not by:
        return spread.orderBy(*order).limit(k)
    return G.rank_in(spread, list(by), order).where(F.col("rank") <= k)


def links_table(mix: DataFrame, k_per_method: DataFrame, methods: list[str]) -> DataFrame:
    """Edge mix with one k_<METHOD> column per community method."""
    wide = (
        k_per_method.groupBy("window_idx")
        .pivot("method", methods)
        .agg(F.first("n_clusters"))
        .withColumnsRenamed({m: f"k_{m}" for m in methods})
    )
    return mix.join(wide, "window_idx", "left")


def heatmap(rows: DataFrame, index: str, column: str, columns: list, value: str = "value"):
    """index x column, first value of each cell."""
    return rows.groupBy(index).pivot(column, columns).agg(F.first(value))


def heatmap_cells(rows: DataFrame, index: list[str], column: str, value: str = "value"):
    """The same cells in long form, for any number of columns."""
    return rows.groupBy(*index, column).agg(F.first(value).alias(value))


# -- factors ---------------------------------------------------------------------


def subject_factors(curve: DataFrame, issuer: str = "source", date: str = "date") -> DataFrame:
    """Nelson-Siegel factors of the market-average curve and of every issuer.

    A date counts for a subject when it has every term of that subject.
    """
    own = curve.select(F.col(issuer).cast("string").alias("subject"), date, "term", "rate")
    market = C.market_curve(curve, date).withColumn("subject", F.lit(MARKET))
    both = own.unionByName(market.select("subject", date, "term", "rate"))
    usable = both.join(C.usable_issuers(both, "subject"), "subject", "left_semi")
    fitted = C.ns_fit(usable, "subject", date)
    return C.factor_table(fitted, ["subject", date])


def factor_trajectory(
    factors: DataFrame, s: Schedule = Schedule(20, 5), subject: str = "subject", date: str = "date"
) -> DataFrame:
    """Mean and population deviation of each factor per subject and window."""
    factors = cut_lineage(factors)
    index = W.date_index(factors, date, (subject,))
    rows = W.bounded_rows(factors, date, s, (subject,), index)
    names = ("level", "slope", "curvature")
    stats = (
        W.spread(rows)
        .groupBy(subject, "window_idx")
        .agg(
            *[F.avg(c).alias(f"{c}_mean") for c in names],
            *[F.stddev_pop(c).alias(f"{c}_std") for c in names],
        )
    )
    ends = W.window_table(index, date, s, (subject,)).select(subject, "window_idx", "date_end")
    return ends.join(stats, [subject, "window_idx"])


def skipped_subjects(curve: DataFrame, trajectory: DataFrame, issuer: str = "source"):
    """Issuers that produced no window."""
    have = trajectory.select(F.col("subject").alias(issuer)).distinct()
    return curve.select(issuer).distinct().join(have, issuer, "left_anti")


def trajectory_points(trajectory: DataFrame, kind: str = "mean", subject: str = "subject"):
    """(subject, window_idx, x, y, z) in window order, of means or deviations."""
    axes = zip("xyz", ("level", "slope", "curvature"), strict=True)
    return trajectory.select(
        subject, "window_idx", *[F.col(f"{c}_{kind}").alias(a) for a, c in axes]
    ).orderBy(subject, "window_idx")


def _mixture_labels(X: np.ndarray, k: int, rounds: int = 200, restarts: int = 10):
    """Full-covariance Gaussian mixture by EM; returns (labels, means)."""
    rng = np.random.default_rng(0)
    n, d = X.shape
    k = min(k, n)
    best = (-np.inf, None, None)
    ridge = 1e-6 * np.eye(d)
    for _ in range(restarts):
        R = np.zeros((n, k))
        seeds = X[rng.choice(n, k, replace=False)]
        R[np.arange(n), ((X[:, None] - seeds) ** 2).sum(axis=2).argmin(axis=1)] = 1.0
        last = -np.inf
        for _ in range(rounds):
            mass = R.sum(axis=0) + 1e-12
            mean = (R.T @ X) / mass[:, None]
            logp = np.empty((n, k))
            for c in range(k):
                D = X - mean[c]
                S = (R[:, c, None] * D).T @ D / mass[c] + ridge
                L = np.linalg.cholesky(S)
                z = np.linalg.solve(L, D.T)
                logp[:, c] = (
                    np.log(mass[c] / n) - 0.5 * (z * z).sum(axis=0) - np.log(np.diag(L)).sum()
                )
            top = logp.max(axis=1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
            R = np.exp(logp - total[:, None])
            score = float(total.mean())
            if score - last < 1e-3 * 1e-3:
                break
            last = score
        if score > best[0]:
            best = (score, R.argmax(axis=1), mean)
    return best[1], best[2]


def regimes(
    trajectory: DataFrame, n_regimes: int = 3, subject: str = "subject", cut: float = REGIME_SLOPE
) -> DataFrame:
    """(subject, window_idx, date_end, regime): mixture of a subject's window means.

    A group is one subject's windows, a few rows per window.  Components are
    named by the mean slope of their centre, in the units of the panel.
    """
    columns = ["level_mean", "slope_mean", "curvature_mean"]
    rows = trajectory.select(subject, "window_idx", "date_end", *columns).dropna(subset=columns)
    schema = T.StructType(
        [
            rows.schema[subject], rows.schema["window_idx"], rows.schema["date_end"],
            T.StructField("component_slope", T.DoubleType()),
        ]
    )

    def fit(pdf):
        pdf = pdf.sort_values("window_idx")
        if len(pdf) < n_regimes:
            return pd.DataFrame(columns=[f.name for f in schema])
        labels, means = _mixture_labels(pdf[columns].to_numpy(), n_regimes)
        out = pdf[[subject, "window_idx", "date_end"]].copy()
        out["component_slope"] = means[labels, 1]
        return out

    slope = F.col("component_slope")
    name = F.when(slope > cut, "Steep").when(slope < -cut, "Inverted").otherwise("Flat")
    return rows.groupBy(subject).applyInPandas(fit, schema).withColumn("regime", name)


def with_regime(trajectory: DataFrame, labelled: DataFrame, subject: str = "subject"):
    """Left join of labels; windows without one show 'none'."""
    on = [subject, "window_idx"]
    joined = trajectory.join(labelled.select(*on, "regime"), on, "left")
    return joined.withColumn("regime", F.coalesce("regime", F.lit("none")))


# -- stress ----------------------------------------------------------------------


def rolling_stress(
    panel: DataFrame, s: Schedule, roles: Roles, index: DataFrame | None = None
) -> DataFrame:
    """Mean, variance and count of |corr| per window over complete dates, and stress.

    Completeness of a date does not depend on the window, so incomplete dates
    go once; windows still count all dates of the index.
    """
    index = W.date_index(panel, roles.date) if index is None else index
    keys = list(roles.keys)
    full = cut_lineage(complete_dates(panel, roles))
    bounded = W.bounded_rows(full, roles.date, s, index=index)
    pairs = W.windowed_pearson(bounded, roles, min_obs=2)
    size = F.abs("measure")
    rows = (
        pairs.where(F.col("measure").isNotNull())
        .groupBy(*keys, "window_idx")
        .agg(
            F.avg(size).alias("avg_abs_corr"),
            F.var_pop(size).alias("corr_variance"),
            F.count(F.when(F.round(size, 9) > SIGNIFICANT, 1)).alias("n_sig_edges"),
        )
    )
    ends = W.window_table(index, roles.date, s).select("window_idx", "date_end")
    group = Window.partitionBy(*keys)
    peak = F.max("avg_abs_corr").over(group)
    return (
        rows.join(ends, "window_idx")
        .withColumn(
            "stress_pct",
            F.when(peak > 0, (1.0 - F.col("avg_abs_corr") / peak) * 100.0).otherwise(0.0),
        )
        .withColumn(
            "stress_band",
            F.when(F.round("stress_pct", 9) > STRESS_BAND, "Stressed (>50)").otherwise("Calm"),
        )
        .withColumn(
            "window_idx",
            (F.row_number().over(group.orderBy("window_idx")) - 1).cast("bigint"),
        )
    )


def middle_term(residuals: DataFrame) -> DataFrame:
    """Residuals of the term at index n // 2 of all terms in maturity order."""
    terms = residuals.select("term", "maturity_years").distinct()
    order = Window.orderBy("maturity_years")
    placed = terms.withColumn("_p", F.row_number().over(order) - 1).withColumn(
        "_n", F.count(F.lit(1)).over(Window.partitionBy())
    )
    chosen = placed.where(F.col("_p") == F.floor(F.col("_n") / 2)).select("term")
    return residuals.join(chosen, "term", "left_semi")


def market_stress(
    residuals: DataFrame, s: Schedule = Schedule(30, 10), drop_absent: bool = True
) -> DataFrame:
    """Stress across issuers at the middle term.

    drop_absent=False keeps an issuer without that term among the sources, so
    that no date is complete and the result is empty.
    """
    index = W.date_index(residuals, "date")
    middle = middle_term(residuals)
    if not drop_absent:
        absent = residuals.select("issuer").distinct().join(
            middle.select("issuer").distinct(), "issuer", "left_anti"
        )
        middle = middle.where(
            absent.select((F.count(F.lit(1)) == 0)).scalar()
        )
    panel = middle.withColumn("market", F.lit(MARKET))
    stress = rolling_stress(panel, s, Roles(("market",), "issuer", "date", "residual"), index)
    return stress.drop("market")


def issuer_stress(residuals: DataFrame, s: Schedule = Schedule(30, 10)) -> DataFrame:
    """Stress across an issuer's own terms; issuers with one term have no rows."""
    index = W.date_index(residuals, "date")
    return rolling_stress(residuals, s, Roles(("issuer",), "term", "date", "residual"), index)


def window_network_summary(nodes: DataFrame, edges: DataFrame, keys=("window_idx",)) -> DataFrame:
    return H.network_summary(nodes, edges, tuple(keys))
