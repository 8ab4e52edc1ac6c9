"""F and W7–W14: curve models, factors and stress."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratanet.catalog.base import query, r6, rounded
from stratanet.catalog.panels import DENSE
from stratanet.catalog.sql import CURVE, TERMS, with_, years
from stratanet.catalog.sql import r6 as q6
from stratanet.catalog.windows import window_sql
from stratanet.functions import loadings as L
from stratanet.functions.maturity import term_years
from stratanet.operators import arbfree as AF
from stratanet.operators import curvefit as C
from stratanet.operators import evolution as E
from stratanet.operators.graph import union_all
from stratanet.operators.panel import dense_rows
from stratanet.operators.windows import Schedule
from stratanet.session import cut_lineage
from stratanet.sources import adapters as A

BY = ("source", "date")
DT = 1.0 / 12.0
_DT = f"{DT!r}e0"


def fit_sql(rows: str, by: str, y: str = "y", tag: str = "") -> str:
    """Betas (be), and fitted rows (fr) with residual, of a table with f1, g, y."""
    on = ", ".join(by.split(","))
    return f"""mo{tag} AS (SELECT {on}, avg(f1) AS af, avg(g) AS ag, avg({y}) AS ay,
    var_pop(f1) AS ff, var_pop(g) AS gg, covar_pop(f1, g) AS fg,
    covar_pop(f1, {y}) AS fy, covar_pop(g, {y}) AS gy FROM {rows} GROUP BY {on}),
cf{tag} AS (SELECT *, (fy * gg - gy * fg) / nullif(ff * gg - fg * fg, 0) AS a,
    (gy * ff - fy * fg) / nullif(ff * gg - fg * fg, 0) AS b FROM mo{tag}),
be{tag} AS (SELECT {on}, ay - a * af - b * ag AS level, a + b AS slope, -b AS curvature FROM cf{tag}),
fr{tag} AS (SELECT r.*, level, slope, curvature,
    {y} - level - slope * f1 - curvature * (f1 - g) AS residual
  FROM {rows} r JOIN be{tag} USING ({on}))"""


def load_sql(source: str = "dense", decay: str = "1.0", name: str = "ld", y: str = "rate") -> str:
    yr = years("term")
    return f"""{name}0 AS (SELECT *, {yr} AS years, {y} AS y FROM {source}),
{name} AS (SELECT *, (1 - exp(-years / {decay})) / (years / {decay}) AS f1,
    exp(-years / {decay}) AS g FROM {name}0)"""


NS = (CURVE, DENSE, load_sql(), fit_sql("ld", "source,date"))
FACTORS = """fa AS (SELECT source, date, any_value(level) AS level, any_value(slope) AS slope,
  any_value(curvature) AS curvature, sqrt(avg(residual * residual)) AS rmse FROM fr GROUP BY 1, 2)"""
FACTOR_COLUMNS = ", ".join(f"{q6(c)} AS {c}" for c in ("level", "slope", "curvature", "rmse"))


def curve(spark, d):
    """The curve panel, written once: every fit reads it several times."""
    return cut_lineage(A.curve_long(spark, d))


@query(
    "f1_ns_basis",
    with_(CURVE, load_sql("(SELECT DISTINCT term, 0.0 AS rate FROM curve)", "1.5"))
    + f"SELECT term, {q6('f1')} AS f1, {q6('f1 - g')} AS f2 FROM ld",
)
def f1(spark, d):
    terms = curve(spark, d).select("term").distinct()
    rows = C.with_loadings(terms, 1.5)
    return rows.select("term", r6("f1").alias("f1"), r6(F.col("f1") - F.col("g")).alias("f2"))


@query("f2_ns_fit", with_(*NS, FACTORS) + f"SELECT source, date, {FACTOR_COLUMNS} FROM fa")
def f2(spark, d):
    fitted = C.ns_fit(curve(spark, d))
    return rounded(C.factor_table(fitted, list(BY)), "level", "slope", "curvature", "rmse").drop(
        "decay"
    )


@query(
    "f3_factor_batch",
    with_(
        CURVE,
        "market AS (SELECT date, term, avg(rate) AS rate FROM curve GROUP BY 1, 2)",
        """mdense AS (SELECT m.* FROM market m JOIN (SELECT date FROM market GROUP BY 1
            HAVING count(*) = (SELECT count(DISTINCT term) FROM market)) USING (date))""",
        load_sql("mdense"), fit_sql("ld", "date"),
    )
    + f"""SELECT date, {q6('any_value(level)')} AS level, {q6('any_value(slope)')} AS slope,
            {q6('any_value(curvature)')} AS curvature,
            {q6('sqrt(avg(residual * residual))')} AS rmse FROM fr GROUP BY 1""",
)
def f3(spark, d):
    """The same batch fit on another grouping: the market-average curve."""
    market = C.market_curve(curve(spark, d)).withColumn("source", F.lit("market"))
    table = C.factor_table(C.ns_fit(market), list(BY))
    return rounded(table, "level", "slope", "curvature", "rmse").drop("decay", "source")


GRID = """grid AS (SELECT unnest(range(0, 50)) AS i),
gd AS (SELECT dense.*, 0.05 + i * ((2.0 - 0.05) / 49) AS decay, i FROM dense, grid)"""
GRID_FIT = (CURVE, DENSE, GRID, load_sql("gd", "decay"), fit_sql("ld", "source,date,i"))
ERRORS = """er AS (SELECT source, date, i, any_value(decay) AS decay,
  sum(residual * residual) AS sse, count(*) AS n FROM fr GROUP BY 1, 2, 3)"""


@query(
    "f4_decay_search",
    with_(*GRID_FIT, ERRORS)
    + f"""SELECT source, date, {q6('decay')} AS decay, {q6('sqrt(sse / n)')} AS rmse FROM (
            SELECT *, row_number() OVER (PARTITION BY source, date ORDER BY sse / n, i) AS r
            FROM er) WHERE r = 1""",
)
def f4(spark, d):
    fitted = C.ns_fit(curve(spark, d), decay=None)
    table = fitted.groupBy(*BY).agg(
        F.first("decay").alias("decay"), F.first("rmse").alias("rmse")
    )
    return rounded(table, "decay", "rmse")


RESIDUAL_BP = q6("residual * 10000")


@query(
    "f5_residual_rows",
    with_(*NS) + f"SELECT source, date, term, {RESIDUAL_BP} AS residual_bp FROM fr",
)
def f5(spark, d):
    fitted = C.ns_fit(curve(spark, d))
    return fitted.select(*BY, "term", r6(F.col("residual") * 1e4).alias("residual_bp"))


#: A ragged panel: one region keeps three terms and must be skipped.
RAGGED = """ragged AS (SELECT * FROM curve
  WHERE source <> 'ASIA' OR term IN ('1Y', '5Y', '10Y'))"""
RAGGED_FIT = (
    CURVE, RAGGED,
    """usable AS (SELECT source FROM ragged GROUP BY 1 HAVING count(DISTINCT term) >= 4)""",
    "kept AS (SELECT * FROM ragged WHERE source IN (SELECT source FROM usable))",
    DENSE.replace("curve", "kept"), load_sql(), fit_sql("ld", "source,date"),
)


def ragged(spark, d):
    return curve(spark, d).where(
        (F.col("source") != "ASIA") | F.col("term").isin("1Y", "5Y", "10Y")
    )


@query(
    "f6_residual_cube",
    with_(*RAGGED_FIT)
    + f"""SELECT source AS issuer, date, term, years AS maturity_years,
            {RESIDUAL_BP} AS residual_bp FROM fr""",
)
def f6(spark, d):
    cube = C.residual_table(ragged(spark, d))
    return cube.select(
        "issuer", "date", "term", "maturity_years",
        r6(F.col("residual") * 1e4).alias("residual_bp"),
    )


@query(
    "f6_skipped_issuers",
    with_(*RAGGED_FIT)
    + "SELECT DISTINCT source FROM ragged WHERE source NOT IN (SELECT source FROM fr)",
)
def f6_skipped(spark, d):
    panel = ragged(spark, d)
    return C.skipped_issuers(panel, C.residual_table(panel))


@query(
    "f7_decay_rate",
    with_(CURVE, load_sql("(SELECT DISTINCT term, 0.0 AS rate FROM curve)"))
    + f"SELECT term, {q6('1.0 / years')} AS rate, {q6('1.0 / (1.0 / years)')} AS decay FROM ld",
)
def f7(spark, d):
    terms = curve(spark, d).select("term", term_years(F.col("term")).alias("decay")).distinct()
    rate = L.decay_to_rate(F.col("decay"))
    return terms.select("term", r6(rate).alias("rate"), r6(L.rate_to_decay(rate)).alias("decay"))


@query(
    "f8_afns_loadings",
    with_(CURVE, load_sql("(SELECT DISTINCT source, term, 0.0 AS rate FROM curve)", "2.0"))
    + f"""SELECT source, term, CAST(1 AS DOUBLE) AS level, {q6('f1')} AS slope,
            {q6('f1 - g')} AS curvature FROM ld""",
)
def f8(spark, d):
    """Arbitrage-free loadings equal the plain basis at the same decay."""
    rows = C.with_loadings(AF.maturity_terms(curve(spark, d)), 2.0, AF.LOADINGS["afns"])
    return rows.select(
        "source", "term", F.lit(1.0).alias("level"), r6("f1").alias("slope"),
        r6(F.col("f1") - F.col("g")).alias("curvature"),
    )


def var_sql(dt: float = DT, pooled: bool = False) -> str:
    """Diagonal volatility per issuer from a VAR(1) on the factors (table fa)."""
    z = range(3)
    lag = ", ".join(
        f"lag({c}) OVER (PARTITION BY source ORDER BY date) AS z{i}"
        for i, c in enumerate(("level", "slope", "curvature"))
    )
    mom = ", ".join(
        [f"covar_pop(x{i}, x{i}) AS v{i}" for i in z]
        + [f"covar_pop(x{i}, z{j}) AS c{i}{j}" for i in z for j in z]
        + [f"covar_pop(z{i}, z{j}) AS q{i}{j}" for i in z for j in z]
    )

    def minor(i, j):
        r = [k for k in z if k != i]
        c = [k for k in z if k != j]
        return f"(q{r[0]}{c[0]} * q{r[1]}{c[1]} - q{r[0]}{c[1]} * q{r[1]}{c[0]})"

    det = f"(q00 * {minor(0, 0)} - q01 * {minor(0, 1)} + q02 * {minor(0, 2)})"

    def inverse(i, j):
        sign = "" if (i + j) % 2 == 0 else "-"
        return f"({sign}{minor(j, i)} / {det})"

    explained = {
        i: " + ".join(f"c{i}{j} * {inverse(j, k)} * c{i}{k}" for j in z for k in z) for i in z
    }
    resid = ", ".join(f"n * (v{i} - ({explained[i]})) AS e{i}" for i in z)
    if pooled:
        pick = ", ".join(
            f"coalesce(sum(CASE WHEN n + 1 >= 12 THEN e{i} END) OVER () / greatest(sum(CASE WHEN"
            f" n + 1 >= 12 THEN n ELSE 0 END) OVER () - 4, 1) / {dt!r}e0, 0) AS s{i + 1}{i + 1}"
            for i in z
        )
    else:
        pick = ", ".join(
            f"CASE WHEN n + 1 >= 12 THEN greatest(e{i} / greatest(n - 4, 1) / {dt!r}e0, 0)"
            f" ELSE 0.0 END AS s{i + 1}{i + 1}"
            for i in z
        )
    return f"""vl AS (SELECT source, date, level AS x0, slope AS x1, curvature AS x2, {lag} FROM fa),
vm AS (SELECT source, count(*) AS n, {mom} FROM vl WHERE z0 IS NOT NULL GROUP BY 1),
ve AS (SELECT source, n, {resid} FROM vm),
sg AS (SELECT source, n + 1 AS n_dates, {pick} FROM ve)"""


def afns_sql(decay: str = "1.0") -> str:
    """Adjustment (aj) per issuer and term from sg, diagonal volatility."""
    x, u = f"(years / {decay})", f"({decay} * {decay})"
    e1, e2 = f"exp(-{x})", f"exp(-2 * {x})"
    m1, m2 = f"((1 - {e1}) / {x})", f"((1 - {e2}) / (2 * {x}))"
    b = f"{u} * (0.5 - {m1} + 0.5 * {m2})"
    c = f"{u} * (0.5 + {e1} - 0.25 * {x} * {e2} - 0.75 * {e2} - 2 * {m1} + 1.25 * {m2})"
    return f"""tm AS (SELECT DISTINCT source, term, years, f1, g FROM ld),
aj AS (SELECT source, term, years, f1, g,
    -(s11 * years * years / 6 + s22 * {b} + s33 * {c}) AS adjustment
  FROM tm JOIN sg USING (source))"""


SPEC = AF.ModelSpec(model="afns", dt=DT)
POOLED = AF.ModelSpec(model="afns", dt=DT, sigma_scope="pooled")
DTSPEC = AF.ModelSpec(model="dtafns", dt=DT)
AFNS = (*NS, FACTORS, var_sql(), afns_sql())
AFNS_FIT = (
    *AFNS,
    "la AS (SELECT ld.*, adjustment, y - adjustment AS ya FROM ld JOIN aj USING (source, term))",
    fit_sql("la", "source,date", "ya", "2"),
)


@query(
    "f9_afns_adjustment",
    with_(*AFNS) + f"SELECT source AS issuer, term, {q6('adjustment')} AS adjustment FROM aj",
)
def f9(spark, d):
    fit = AF.fit_model(curve(spark, d), SPEC)
    return fit.adjustment.select("issuer", "term", r6("adjustment").alias("adjustment"))


def period_sql(dt: float = DT) -> dict[str, str]:
    lam = f"(1 - exp(-{dt!r}e0))"
    rho = f"exp(-{dt!r}e0)"
    return {
        "b2": f"((1 - pow({rho}, n)) / {lam})",
        "b3": f"((1 - pow({rho}, n - 1)) / {lam} - (n - 1) * pow({rho}, n - 1))",
    }


@query(
    "f10_dtafns_loadings",
    with_(CURVE, f"tm AS (SELECT DISTINCT term, {years('term')} / {_DT} AS n FROM curve)")
    + f"""SELECT term, {q6(period_sql()['b2'] + ' / n')} AS slope,
            {q6(period_sql()['b3'] + ' / n')} AS curvature FROM tm""",
)
def f10(spark, d):
    terms = curve(spark, d).select("term").distinct()
    rows = C.with_loadings(terms, 1.0, lambda y, k: L.discrete_loadings(y, k, DT))
    return rows.select(
        "term", r6("f1").alias("slope"), r6(F.col("f1") - F.col("g")).alias("curvature")
    )


_P = period_sql()
DT_NS = (
    CURVE, DENSE,
    f"""ld AS (SELECT *, {_P['b2']} / n AS f1, ({_P['b2']} - {_P['b3']}) / n AS g
      FROM (SELECT *, {years('term')} AS years, {years('term')} / {_DT} AS n, rate AS y FROM dense))""",
    fit_sql("ld", "source,date"), FACTORS, var_sql(),
)


@query(
    "f11_dtafns_adjustment",
    with_(
        *DT_NS,
        f"""tm AS (SELECT term, years, round(years / {_DT}) AS h FROM
              (SELECT DISTINCT term, years FROM ld)),
        ps AS (SELECT term, years, unnest(range(1, CAST(h AS BIGINT))) AS n FROM tm),
        qs AS (SELECT term, years, sum(n * n) AS q1, sum({_P['b2']} * {_P['b2']}) AS q2,
               sum({_P['b3']} * {_P['b3']}) AS q3 FROM ps GROUP BY 1, 2)""",
    )
    + f"""SELECT source AS issuer, term,
            {q6(f'-(0.5 * {_DT} * {_DT} * {_DT} * (s11 * q1 + s22 * q2 + s33 * q3)) / years')}
            AS adjustment FROM qs, sg""",
)
def f11(spark, d):
    fit = AF.fit_model(curve(spark, d), DTSPEC)
    return fit.adjustment.select("issuer", "term", r6("adjustment").alias("adjustment"))


@query(
    "f12_adjusted_residuals",
    with_(*AFNS_FIT)
    + f"SELECT source AS issuer, date, term, {RESIDUAL_BP} AS residual_bp FROM fr2",
)
def f12(spark, d):
    fit = AF.fit_model(curve(spark, d), SPEC)
    return fit.residuals.select(
        "issuer", "date", "term", r6(F.col("residual") * 1e4).alias("residual_bp")
    )


SIGMA = ", ".join(f"{q6(f'sqrt(s{k})')} AS sigma_{k}" for k in ("11", "22", "33"))


def _sigma(fit):
    return fit.sigma.select(
        "issuer", "n_dates",
        *[r6(F.sqrt(f"s{k}")).alias(f"sigma_{k}") for k in ("11", "22", "33")],
    )


@query(
    "f13_var_volatility",
    with_(*NS, FACTORS, var_sql()) + f"SELECT source AS issuer, n_dates, {SIGMA} FROM sg",
)
def f13(spark, d):
    return _sigma(AF.fit_model(curve(spark, d), SPEC))


@query("f13_mean_reversion")
def f13_kappa(spark, d):
    fit = AF.fit_model(curve(spark, d), SPEC)
    kappa = AF.mean_reversion(fit.sigma, DT, "issuer")
    return kappa.select("issuer", F.posexplode("kappa_p").alias("cell", "kappa"))


@query("f13_correlated_volatility")
def f13_correlated(spark, d):
    spec = AF.ModelSpec(model="afns", dt=DT, correlated_sigma=True)
    return AF.fit_model(curve(spark, d), spec).sigma.drop("phi")


@query(
    "f14_two_step_factors",
    with_(*AFNS_FIT)
    + f"""SELECT source AS issuer, date, {q6('any_value(level)')} AS level,
            {q6('any_value(slope)')} AS slope, {q6('any_value(curvature)')} AS curvature,
            {q6('sqrt(avg(residual * residual))')} AS rmse FROM fr2 GROUP BY 1, 2""",
)
def f14(spark, d):
    fit = AF.fit_model(curve(spark, d), SPEC)
    return rounded(fit.factors, "level", "slope", "curvature", "rmse").drop("decay")


@query(
    "f15_pooled_volatility",
    with_(*NS, FACTORS, var_sql(pooled=True)) + f"SELECT source AS issuer, n_dates, {SIGMA} FROM sg",
)
def f15(spark, d):
    return _sigma(AF.fit_model(curve(spark, d), POOLED))


@query("f16_model_registry")
def f16(spark, d):
    """Every registered model fitted to the same panel: size of its residuals."""
    from stratanet.plans.compare import fit_all, residual_size, stacked_residuals

    specs = [AF.ModelSpec(model=m, dt=DT) for m in ("ns", "afns", "dtafns")]
    fits = fit_all(curve(spark, d), specs)
    return rounded(residual_size(stacked_residuals(fits)), "rmse", "mae")


@query(
    "f17_panel_decay",
    with_(*GRID_FIT, ERRORS)
    + f"""SELECT source, {q6('decay')} AS decay, {q6('sse')} AS sse FROM (
            SELECT source, i, any_value(decay) AS decay, sum(sse) AS sse, row_number() OVER (
              PARTITION BY source ORDER BY sum(sse), i) AS r FROM er GROUP BY 1, 2) WHERE r = 1""",
)
def f17(spark, d):
    dense = dense_rows(curve(spark, d), "source", "date", "term")
    return rounded(C.panel_decay(dense), "decay", "sse")


@query(
    "f18_unit_shapes",
    with_(
        CURVE, load_sql("(SELECT DISTINCT term, 0.0 AS rate FROM curve)"),
        "one AS (SELECT 1.0 AS s)",
    )
    + f"""SELECT term, {q6('-years * years / 6')} AS u_s11,
       {q6('-(0.5 - f1 + 0.25 * (1 - g * g) / years)')} AS u_s22,
       {q6('-(0.5 + g - 0.25 * years * g * g - 0.75 * g * g - 2 * f1 + 0.625 * (1 - g * g) / years)')} AS u_s33
       FROM ld""",
)
def f18(spark, d):
    terms = curve(spark, d).select("term", term_years(F.col("term")).alias("years")).distinct()
    shapes = L.afns_shapes(F.col("years"), 1.0)
    return terms.select("term", *[r6(-shapes[k]).alias(f"u_{k}") for k in ("s11", "s22", "s33")])


@query("f19_kalman_filter")
def f19(spark, d):
    from stratanet.operators import statespace as K

    fits = K.seed_parameters(curve(spark, d), SPEC)
    return rounded(K.filter_cells(fits).select("issuer", "cell", "loglik"), "loglik")


@query("f20_likelihood_choice")
def f20(spark, d):
    from stratanet.operators import statespace as K

    return rounded(K.choose_parameters(curve(spark, d), SPEC).select(
        "issuer", "estimator", "loglik", "seed_loglik"), "loglik", "seed_loglik")


@query("f20_filtered_residuals")
def f20_residuals(spark, d):
    from stratanet.operators import statespace as K

    fit = K.fit_state_space(curve(spark, d), SPEC)
    return rounded(fit.residuals, "residual")


def _by_source(spark, d, part: int):
    """Components of every issuer's own curve; there are as many plans as issuers."""
    panel = cut_lineage(curve(spark, d))
    sources = sorted(r[0] for r in panel.select("source").distinct().collect())
    tables = [
        C.curve_pca(panel.where(F.col("source") == s), "date", TERMS)[part].withColumn("source", F.lit(s))
        for s in sources
    ]
    return union_all(tables)


@query("f21_curve_pca")
def f21(spark, d):
    return rounded(_by_source(spark, d, 0), "pc1", "pc2", "pc3", "reconstruction_rmse")


@query("f21_pca_loadings")
def f21_loadings(spark, d):
    return rounded(_by_source(spark, d, 1), "loading", "explained_ratio")


@query(
    "f22_interlayer_weights",
    with_(*NS, FACTORS)
    + f"""SELECT source, {q6('least(1, greatest(0, 0.7 * e / (1 + e) + 0.15))')} AS weight FROM (
            SELECT source, abs(avg(slope)) + abs(avg(curvature)) AS e FROM fa GROUP BY 1)""",
)
def f22(spark, d):
    factors = C.factor_table(C.ns_fit(curve(spark, d)), list(BY))
    return rounded(C.interlayer_weights(factors), "weight")


@query(
    "f23_node_importance",
    with_(CURVE)
    + f"""SELECT source, {q6('v / sum(v) OVER ()')} AS importance FROM (
            SELECT source, var_pop(rate) AS v FROM curve GROUP BY 1)""",
)
def f23(spark, d):
    return rounded(C.node_importance(curve(spark, d), "source", "rate"), "importance")


# -- windows over factors and residuals -------------------------------------------


@query(
    "w7_market_curve",
    with_(CURVE) + f"SELECT date, term, {q6('avg(rate) * 10000')} AS rate_bp FROM curve GROUP BY 1, 2",
)
def w7(spark, d):
    market = C.market_curve(curve(spark, d))
    return market.select("date", "term", r6(F.col("rate") * 1e4).alias("rate_bp"))


TRAJECTORY = Schedule(20, 5)
SUBJECTS = """both_ AS (SELECT source AS subject, date, term, rate FROM curve
  UNION ALL SELECT '__market__', date, term, avg(rate) FROM curve GROUP BY 1, 2, 3)"""
SUBJECT_FIT = (
    CURVE, SUBJECTS,
    DENSE.replace("curve c", "both_ c").replace("FROM curve", "FROM both_").replace(
        "source", "subject"
    ),
    load_sql(), fit_sql("ld", "subject,date"),
    """fa AS (SELECT subject, date, any_value(level) AS level, any_value(slope) AS slope,
      any_value(curvature) AS curvature, sqrt(avg(residual * residual)) AS rmse,
      row_number() OVER (PARTITION BY subject ORDER BY date) - 1 AS t FROM fr GROUP BY 1, 2)""",
    f"""kx AS (SELECT subject, unnest(range(0, CAST(floor((n - {TRAJECTORY.size}) /
          {TRAJECTORY.step}.0) AS BIGINT) + 1)) AS k FROM (
          SELECT subject, count(*) AS n FROM fa GROUP BY 1)),
    tj AS (SELECT kx.subject, k AS window_idx, max(date) AS date_end,
          avg(level) AS level_mean, stddev_pop(level) AS level_std,
          avg(slope) AS slope_mean, stddev_pop(slope) AS slope_std,
          avg(curvature) AS curvature_mean, stddev_pop(curvature) AS curvature_std
        FROM kx JOIN fa ON fa.subject = kx.subject AND t BETWEEN k * {TRAJECTORY.step}
          AND k * {TRAJECTORY.step} + {TRAJECTORY.size} - 1 GROUP BY 1, 2)""",
)
_STATS = [f"{c}_{k}" for c in ("level", "slope", "curvature") for k in ("mean", "std")]
STAT_COLUMNS = ", ".join(f"{q6(c)} AS {c}" for c in _STATS)


def _trajectory(spark, d):
    return E.factor_trajectory(E.subject_factors(curve(spark, d)), TRAJECTORY)


@query(
    "w8_factor_trajectory",
    with_(*SUBJECT_FIT)
    + f"SELECT window_idx, date_end, {STAT_COLUMNS} FROM tj WHERE subject = '__market__'",
)
def w8(spark, d):
    market = _trajectory(spark, d).where(F.col("subject") == E.MARKET).drop("subject")
    return rounded(market, *_STATS)


@query(
    "w9_factor_evolution",
    with_(*SUBJECT_FIT) + f"SELECT subject, window_idx, date_end, {STAT_COLUMNS} FROM tj",
)
def w9(spark, d):
    return rounded(_trajectory(spark, d), *_STATS)


@query(
    "w9_skipped_issuers",
    with_(*RAGGED_FIT)
    + """SELECT DISTINCT source FROM ragged WHERE source NOT IN (
           SELECT source FROM fr GROUP BY 1 HAVING count(DISTINCT date) >= 20)""",
)
def w9_skipped(spark, d):
    panel = ragged(spark, d)
    trajectory = E.factor_trajectory(E.subject_factors(panel), TRAJECTORY)
    return E.skipped_subjects(panel, trajectory)


@query("w10_regimes")
def w10(spark, d):
    labelled = E.regimes(_trajectory(spark, d), cut=0.005)
    return labelled.select("subject", "window_idx", "date_end", "regime")


@query(
    "j4_factors_with_regime",
    with_(*SUBJECT_FIT)
    + "SELECT subject, window_idx, CAST(1 AS BIGINT) AS n_labels FROM tj",
)
def j4(spark, d):
    """Left join keeps every window; each has exactly one label."""
    trajectory = _trajectory(spark, d)
    joined = E.with_regime(trajectory, E.regimes(trajectory, cut=0.005))
    return joined.groupBy("subject", "window_idx").agg(F.count("regime").alias("n_labels"))


@query(
    "j4_given_labels",
    with_(*SUBJECT_FIT)
    + "SELECT subject, window_idx, CASE WHEN window_idx % 2 = 0 THEN 'even' ELSE 'none' END AS regime FROM tj",
)
def j4_given(spark, d):
    """Labels of every other window; the rest keep their rows."""
    trajectory = _trajectory(spark, d)
    even = trajectory.where("window_idx % 2 = 0").select("subject", "window_idx", F.lit("even").alias("regime"))
    return E.with_regime(trajectory, even).select("subject", "window_idx", "regime")


@query(
    "w14_trajectory_points",
    with_(*SUBJECT_FIT)
    + f"""SELECT subject, window_idx, {q6('level_std')} AS x, {q6('slope_std')} AS y,
            {q6('curvature_std')} AS z FROM tj ORDER BY 1, 2""",
)
def w14(spark, d):
    return rounded(E.trajectory_points(_trajectory(spark, d), "std"), "x", "y", "z")


STRESS = Schedule(24, 6)


def stress_sql(source: str, key: str, node: str) -> tuple[str, ...]:
    """Windows over all dates of fr, complete dates of ``source`` only."""
    return (
        window_sql("fr", STRESS, "date"),
        f"""wn AS (SELECT {key} AS layer, count(DISTINCT {node}) AS w FROM {source} GROUP BY 1),
cd AS (SELECT {key} AS layer, date FROM {source} JOIN wn ON wn.layer = {key}
       GROUP BY 1, 2, w HAVING count(*) = w),
st AS (SELECT {key} AS layer, {node} AS node, s.date AS dt, residual AS value FROM {source} s
       JOIN cd ON cd.layer = {key} AND cd.date = s.date),
pr AS (SELECT ww.window_idx, date_end, a.layer, a.node AS node_i, b.node AS node_j,
         a.value AS x, b.value AS y FROM st a JOIN st b ON a.layer = b.layer AND a.dt = b.dt
         AND a.node < b.node JOIN ww ON a.dt BETWEEN date_start AND date_end),
pc AS (SELECT layer, window_idx, date_end, abs(CASE WHEN count(*) >= 2 AND stddev_pop(x) > 0
         AND stddev_pop(y) > 0 THEN corr(x, y) END) AS c FROM pr GROUP BY 1, 2, 3, node_i, node_j),
sw AS (SELECT layer, row_number() OVER (PARTITION BY layer ORDER BY window_idx) - 1 AS window_idx,
         date_end, avg(c) AS avg_abs_corr, var_pop(c) AS corr_variance,
         count(*) FILTER (round(c, 9) > 0.5) AS n_sig_edges
       FROM pc WHERE c IS NOT NULL GROUP BY layer, pc.window_idx, date_end),
sx AS (SELECT *, CASE WHEN max(avg_abs_corr) OVER (PARTITION BY layer) > 0 THEN
         (1 - avg_abs_corr / max(avg_abs_corr) OVER (PARTITION BY layer)) * 100 ELSE 0 END AS p FROM sw)""",
    )


_STRESS_COLUMNS = f"""window_idx, date_end, {q6('avg_abs_corr')} AS avg_abs_corr,
  {q6('corr_variance')} AS corr_variance, n_sig_edges, {q6('p')} AS stress_pct,
  CASE WHEN round(p, 9) > 50 THEN 'Stressed (>50)' ELSE 'Calm' END AS stress_band"""
_STRESS = ("avg_abs_corr", "corr_variance", "stress_pct")


@query(
    "w11_stress",
    with_(*NS, "src AS (SELECT *, term AS k FROM fr)", *stress_sql("src", "k", "source"))
    + f"SELECT layer AS term, {_STRESS_COLUMNS} FROM sx",
)
def w11(spark, d):
    """Stress across issuers at every term."""
    from stratanet.operators.pairs import Roles
    from stratanet.operators.windows import date_index

    residuals = cut_lineage(C.residual_table(curve(spark, d)))
    stress = E.rolling_stress(
        residuals, STRESS, Roles(("term",), "issuer", "date", "residual"), date_index(residuals, "date")
    )
    return rounded(stress, *_STRESS)


@query(
    "w12_market_stress",
    with_(*NS, "src AS (SELECT *, 'all' AS k FROM fr WHERE term = '10Y')",
          *stress_sql("src", "k", "source"))
    + f"SELECT {_STRESS_COLUMNS} FROM sx",
)
def w12(spark, d):
    residuals = cut_lineage(C.residual_table(curve(spark, d)))
    return rounded(E.market_stress(residuals, STRESS), *_STRESS)


@query(
    "w13_issuer_stress",
    with_(*NS, *stress_sql("fr", "source", "term"))
    + f"SELECT layer AS issuer, {_STRESS_COLUMNS} FROM sx",
)
def w13(spark, d):
    residuals = cut_lineage(C.residual_table(curve(spark, d)))
    return rounded(E.issuer_stress(residuals, STRESS), *_STRESS)
