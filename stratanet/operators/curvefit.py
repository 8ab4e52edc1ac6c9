"""Cross-sectional curve fits: one pass over the panel, closed form per date."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratanet.functions.loadings import ns_loadings
from stratanet.functions.moments import safe_corr
from stratanet.functions.maturity import canonical_term, term_years
from stratanet.operators.panel import dense_rows
from stratanet.sources.tables import QueryError

#: Search grid of decays, and the least number of terms of a curve.
DECAY_GRID = tuple(float(v) for v in np.linspace(0.05, 2.0, 50))
MIN_TERMS = 4

Loadings = Callable[[Column, Column | float], tuple[Column, Column]]


def with_years(curve: DataFrame) -> DataFrame:
    return curve.withColumn("years", term_years(F.col("term")))


def with_loadings(
    curve: DataFrame, decay: Column | float = 1.0, loadings: Loadings = ns_loadings
) -> DataFrame:
    """Add years, f1 and g to rows that carry a ``term``."""
    f1, g = loadings(F.col("years"), decay)
    if "years" not in curve.columns:
        curve = with_years(curve)
    return curve.withColumn("f1", f1).withColumn("g", g)


def _moments(y: str) -> dict[str, Column]:
    f, g, v = F.col("f1"), F.col("g"), F.col(y)
    return {
        "_af": F.avg(f), "_ag": F.avg(g), "_ay": F.avg(v),
        "_ff": F.var_pop(f), "_gg": F.var_pop(g), "_fg": F.covar_pop(f, g),
        "_fy": F.covar_pop(f, v), "_gy": F.covar_pop(g, v),
    }


_MOMENTS = ("_af", "_ag", "_ay", "_ff", "_gg", "_fg", "_fy", "_gy")


def _solve(df: DataFrame) -> DataFrame:
    """level, slope, curvature from centred second moments; null when collinear."""
    det = F.expr("_ff * _gg - _fg * _fg")
    return (
        df.withColumn("_det", F.when(det > 0, det))
        .withColumns(
            {
                "_cf": F.expr("(_fy * _gg - _gy * _fg) / _det"),
                "_cg": F.expr("(_gy * _ff - _fy * _fg) / _det"),
            }
        )
        .withColumns(
            {
                "level": F.expr("_ay - _cf * _af - _cg * _ag"),
                "slope": F.expr("_cf + _cg"),
                "curvature": F.expr("-_cg"),
            }
        )
        .drop(*_MOMENTS, "_det", "_cf", "_cg")
    )


def fit_rows(rows: DataFrame, by: list[str], y: str = "rate") -> DataFrame:
    """Add level, slope, curvature, residual and rmse to every row of a curve.

    All aggregates share one window, so the panel is shuffled once.
    """
    w = Window.partitionBy(*by)
    moments = {k: c.over(w) for k, c in _moments(y).items()}
    fitted = _solve(rows.withColumns(moments)).withColumn(
        "residual", F.expr(f"`{y}` - level - slope * f1 - curvature * (f1 - g)")
    )
    return fitted.withColumn("rmse", F.sqrt(F.avg(F.expr("residual * residual")).over(w)))


def factor_table(fitted: DataFrame, by: list[str], decay: Column | float = 1.0) -> DataFrame:
    """One row per curve; the rows are already together, so nothing moves."""
    decay = F.lit(float(decay)) if isinstance(decay, (int, float)) else decay
    return (
        fitted.groupBy(*by)
        .agg(*[F.first(c).alias(c) for c in ("level", "slope", "curvature", "rmse")])
        .withColumn("decay", decay)
    )


def ns_fit(
    curve: DataFrame,
    issuer: str = "source",
    date: str = "date",
    decay: float | None = 1.0,
    loadings: Loadings = ns_loadings,
) -> DataFrame:
    """(issuer, date, term, rate, …, residual, rmse, decay) on dense dates."""
    dense = dense_rows(curve, issuer, date, "term")
    if decay is None:
        dense = with_best_decay(dense, [issuer, date], loadings)
    else:
        dense = dense.withColumn("decay", F.lit(float(decay)))
    return fit_rows(with_loadings(dense, F.col("decay"), loadings), [issuer, date])


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _squared_error(points: Column, decay: Column, loadings: Loadings) -> Column:
    """Sum of squared residuals of the best curve through (years, y) at a decay; null when collinear."""

    def loaded(p: Column) -> Column:
        f1, g = loadings(p["years"], decay)
        return F.struct(f1.alias("f"), g.alias("g"), p["y"].alias("y"))

    def summed(rows: Column, **parts: Callable[[Column], Column]) -> Column:
        zero = F.struct(*[F.lit(0.0).alias(k) for k in parts])
        return F.aggregate(rows, zero, lambda a, p: F.struct(*[(a[k] + of(p)).alias(k) for k, of in parts.items()]))

    def about_means(rows: Column) -> Column:
        n = F.size(rows)
        sums = summed(rows, f=lambda p: p["f"], g=lambda p: p["g"], y=lambda p: p["y"])
        return _let(sums, lambda m: F.transform(rows, lambda p: F.struct(*[(p[k] - m[k] / n).alias(k) for k in "fgy"])))

    def left(rows: Column) -> Column:
        products = {a + b: (lambda p, a=a, b=b: p[a] * p[b]) for a, b in ("ff", "gg", "fg", "fy", "gy")}

        def solved(s: Column) -> Column:
            det = s["ff"] * s["gg"] - s["fg"] * s["fg"]
            det = F.when(det > 0, det)
            return F.struct(
                ((s["fy"] * s["gg"] - s["gy"] * s["fg"]) / det).alias("f"), ((s["gy"] * s["ff"] - s["fy"] * s["fg"]) / det).alias("g")
            )

        def square(p: Column, c: Column) -> Column:
            gap = p["y"] - c["f"] * p["f"] - c["g"] * p["g"]
            return gap * gap

        return _let(summed(rows, **products), lambda s: _let(solved(s), lambda c: summed(rows, sse=lambda p: square(p, c))["sse"]))

    return _let(F.transform(points, loaded), lambda rows: _let(about_means(rows), left))


def _grid_errors(points: Column, loadings: Loadings) -> Column:
    """(sse, decay) of the points at every decay of the grid."""
    grid = F.array(*[F.lit(d) for d in DECAY_GRID])
    return F.transform(grid, lambda d: F.struct(_squared_error(points, d, loadings).alias("sse"), d.alias("decay")))


def _errors_of_grid(curve: DataFrame, by: list[str], loadings: Loadings) -> DataFrame:
    """(by, n, errors): the squared error at every decay of the grid, in one row a curve.

    The points of a curve, one for each of its terms, come together once; the
    grid is tried on them where they are.
    """
    point = F.struct("years", F.col("rate").cast("double").alias("y"))
    curves = with_years(curve).groupBy(*by).agg(F.collect_list(point).alias("_points"))
    return curves.select(*by, F.size("_points").alias("n"), _grid_errors(F.col("_points"), loadings).alias("errors"))


def with_best_decay(curve: DataFrame, by: list[str], loadings: Loadings = ns_loadings) -> DataFrame:
    """The rows with the best decay of their curve; they stay where the search has brought them together."""
    curve = with_years(curve)
    rest = [c for c in curve.columns if c not in by]
    curves = curve.groupBy(*by).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    points = F.transform("_rows", lambda r: F.struct(r["years"].alias("years"), r["rate"].cast("double").alias("y")))
    best = curves.withColumn("decay", F.array_min(_grid_errors(points, loadings))["decay"])
    return best.select(*by, "decay", F.explode("_rows").alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest], "decay")


def decay_errors(
    curve: DataFrame, by: list[str], loadings: Loadings = ns_loadings
) -> DataFrame:
    """(by, decay, sse, n) for the whole grid."""
    rows = _errors_of_grid(curve, by, loadings).select(*by, "n", F.explode("errors").alias("e"))
    return rows.select(*by, "e.decay", "e.sse", F.col("n").cast("bigint").alias("n"))


def search_decay(curve: DataFrame, by: list[str], loadings: Loadings = ns_loadings):
    """(by, decay): least rmse, the smallest decay on ties."""
    return _errors_of_grid(curve, by, loadings).select(*by, F.array_min("errors")["decay"].alias("decay"))


def panel_decay(
    curve: DataFrame, issuer: str = "source", date: str = "date",
    loadings: Loadings = ns_loadings,
) -> DataFrame:
    """(issuer, decay, sse): one decay per issuer by total squared error."""
    errors = decay_errors(curve, [issuer, date], loadings)
    total = errors.groupBy(issuer, "decay").agg(F.sum("sse").alias("sse"))
    return (
        total.groupBy(issuer)
        .agg(F.min(F.struct("sse", "decay")).alias("_b"))
        .select(issuer, "_b.decay", "_b.sse")
    )


def residual_table(
    curve: DataFrame, issuer: str = "source", date: str = "date",
    decay: float | None = 1.0, loadings: Loadings = ns_loadings,
) -> DataFrame:
    """(issuer, date, term, maturity_years, residual): the long residual cube.

    Labels are canonical, so 12M and 1Y are one term.  Issuers with fewer than
    four terms have no rows; see skipped_issuers.
    """
    enough = usable_issuers(curve, issuer)
    kept = curve.join(enough, issuer, "left_semi")
    fitted = ns_fit(kept, issuer, date, decay, loadings)
    return fitted.select(
        F.col(issuer).alias("issuer"),
        F.col(date).alias("date"),
        canonical_term(F.col("term")).alias("term"),
        F.col("years").alias("maturity_years"),
        "residual",
    )


def usable_issuers(curve: DataFrame, issuer: str = "source") -> DataFrame:
    terms = curve.select(issuer, "term").where(term_years(F.col("term")).isNotNull())
    return (
        terms.distinct()
        .groupBy(issuer)
        .agg(F.count(F.lit(1)).alias("_t"))
        .where(F.col("_t") >= MIN_TERMS)
        .select(issuer)
    )


def skipped_issuers(curve: DataFrame, residuals: DataFrame, issuer: str = "source"):
    """Issuers of the panel without a residual row."""
    have = residuals.select(F.col("issuer").alias(issuer)).distinct()
    return curve.select(issuer).distinct().join(have, issuer, "left_anti")


def check_cube(residuals: DataFrame) -> None:
    """Raise when the cube is too small to network."""
    n = residuals.agg(
        F.count_distinct("term").alias("terms"),
        F.count_distinct("issuer").alias("issuers"),
        F.count_distinct("date").alias("dates"),
    ).first()
    for what, least in (("terms", MIN_TERMS), ("issuers", 2), ("dates", 3)):
        if n[what] < least:
            raise QueryError(f"need at least {least} {what}, got {n[what]}")


def market_curve(curve: DataFrame, date: str = "date") -> DataFrame:
    return curve.groupBy(date, "term").agg(F.avg("rate").alias("rate"))


def interlayer_weights(factors: DataFrame, issuer: str = "source") -> DataFrame:
    """Inter-layer weight of an issuer from how much its curve bends."""
    bend = F.abs(F.avg("slope")) + F.abs(F.avg("curvature"))
    weight = 0.7 * bend / (1.0 + bend) + 0.3 * 0.5
    return factors.groupBy(issuer).agg(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight)).alias("weight")
    )


def node_importance(profile: DataFrame, node: str, value: str, by: tuple[str, ...] = ()):
    """Share of a node's profile variance in the total of its group."""
    own = profile.groupBy(*by, node).agg(F.var_pop(value).alias("_var"))
    total = own.groupBy(*by).agg(F.sum("_var").alias("_all"))
    joined = own.join(total, list(by)) if by else own.withColumn(
        "_all", own.select(F.sum("_var")).scalar()
    )
    return joined.select(
        *by, node, F.when(F.col("_all") > 0, F.col("_var") / F.col("_all")).alias("importance")
    )


def curve_pca(curve: DataFrame, date: str, terms: list[str], k: int = 3):
    """(scores, loadings, explained): components of standardised listwise yields.

    Moments are pair sums over dates; only the terms x terms matrix, whose size
    is the number of maturities, is decomposed.
    """
    wide = (
        curve.groupBy(date).pivot("term", terms).agg(F.first("rate")).dropna()
    )
    means = wide.agg(
        *[F.avg(f"`{t}`").alias(f"m{i}") for i, t in enumerate(terms)],
        *[F.stddev_pop(f"`{t}`").alias(f"s{i}") for i, t in enumerate(terms)],
        *[
            safe_corr(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"c{i}_{j}")
            for i, a in enumerate(terms)
            for j, b in enumerate(terms)
            if i < j
        ],
    ).first()
    p = len(terms)
    C = np.eye(p)
    for i in range(p):
        for j in range(i + 1, p):
            C[i, j] = C[j, i] = means[f"c{i}_{j}"] or 0.0
    values, vectors = np.linalg.eigh(C)
    order = np.argsort(values)[::-1][:k]
    V = vectors[:, order]
    V = V * np.sign(V[np.abs(V).argmax(axis=0), range(k)])
    share = values[order] / values.sum()
    spark = curve.sparkSession
    z = [
        F.try_divide(F.col(f"`{t}`") - F.lit(means[f"m{i}"]), F.lit(means[f"s{i}"]))
        for i, t in enumerate(terms)
    ]
    score = [
        sum((z[i] * float(V[i, c]) for i in range(1, p)), z[0] * float(V[0, c])) for c in range(k)
    ]
    back = [
        z[i] - sum((score[c] * float(V[i, c]) for c in range(1, k)), score[0] * float(V[i, 0]))
        for i in range(p)
    ]
    scores = wide.select(
        date,
        *[s.alias(f"pc{c + 1}") for c, s in enumerate(score)],
        F.sqrt(sum((b * b for b in back[1:]), back[0] * back[0]) / p).alias("reconstruction_rmse"),
    )
    loadings = spark.createDataFrame(
        [(t, c + 1, float(V[i, c]), float(share[c])) for i, t in enumerate(terms) for c in range(k)],
        T.StructType([
            T.StructField("term", T.StringType()), T.StructField("component", T.IntegerType()),
            T.StructField("loading", T.DoubleType()), T.StructField("explained_ratio", T.DoubleType()),
        ]),
    )
    return scores, loadings
