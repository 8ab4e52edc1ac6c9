"""R and the joins of §2.3 that belong to model comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratanet.catalog.base import query, r6, rounded
from stratanet.catalog.curves import AFNS_FIT, DT, NS, curve
from stratanet.catalog.graphs import _DENS, BOTH, MIX, PATHS, REACH, SIZES, TRI, recursive
from stratanet.catalog.sql import CORR, CURVE, with_, years
from stratanet.catalog.sql import r6 as q6
from stratanet.operators import arbfree as AF
from stratanet.operators import curvefit as C
from stratanet.operators import residuals as R
from stratanet.operators.panel import NetworkKind
from stratanet.plans import compare as M
from stratanet.session import cut_lineage

T = 0.1
LAGS = 5
SPECS = [AF.ModelSpec(model="ns", dt=DT), AF.ModelSpec(model="afns", dt=DT)]
PAIR = [("ns", "afns/per_issuer")]


def network_sql(source: str, label: str, node: str, t: float = T) -> tuple[str, ...]:
    """nd and ed (keyed by layer) of |corr| > t on complete dates."""
    return (
        f"""nd AS (SELECT DISTINCT {label} AS layer, {node} AS node FROM {source}),
nw AS (SELECT layer, count(*) AS w FROM nd GROUP BY 1),
fd AS (SELECT {label} AS layer, date FROM {source} JOIN nw ON layer = {label}
       GROUP BY 1, 2, w HAVING count(*) = w),
rr AS (SELECT {label} AS layer, {node} AS node, s.date AS dt, residual AS value FROM {source} s
       JOIN fd ON fd.layer = {label} AND fd.date = s.date),
pr AS (SELECT a.layer, a.node AS node_i, b.node AS node_j, a.value AS x, b.value AS y
  FROM rr a JOIN rr b ON a.layer = b.layer AND a.dt = b.dt AND a.node < b.node),
ed AS (SELECT * FROM (SELECT layer, node_i AS src, node_j AS dst, {CORR} AS weight, {CORR} AS strength
  FROM pr GROUP BY 1, 2, 3) WHERE round(abs(coalesce(weight, 0)), 9) > {t})""",
    )


def _residuals(spark, d):
    return cut_lineage(C.residual_table(curve(spark, d)))


def _networks(spark, d, kind=NetworkKind.ISSUER_BY_TERM):
    nodes, edges = R.residual_networks(_residuals(spark, d), kind, T)
    return nodes, cut_lineage(edges)


EDGES = f"SELECT layer AS label, src, dst, {q6('weight')} AS weight FROM ed"


@query("r1_residual_network", with_(*NS, *network_sql("fr", "term", "source")) + EDGES)
def r1(spark, d):
    return rounded(_networks(spark, d)[1].drop("strength"), "weight")


@query("r2_term_networks", with_(*NS, *network_sql("fr", "source", "term")) + EDGES)
def r2(spark, d):
    edges = _networks(spark, d, NetworkKind.TERM_BY_ISSUER)[1]
    return rounded(edges.drop("strength"), "weight")


_SUMMARY = """density edge_density avg_degree avg_clustering transitivity
  avg_shortest_path_length avg_eccentricity degree_assortativity avg_neighbor_degree""".split()


@query(
    "r3_summary",
    recursive(with_(*NS, *network_sql("fr", "source", "term"), BOTH, SIZES, REACH, TRI, PATHS, MIX))
    + f"""SELECT layer AS label, n_nodes, n_edges, {q6(_DENS + ' ELSE 0.0 END')} AS density,
       {q6(_DENS + ' END')} AS edge_density, {q6('2.0 * n_edges / n_nodes')} AS avg_degree,
       n_components, largest_component_size, is_connected, n_triangles,
       {q6('avg_clustering')} AS avg_clustering, {q6('transitivity')} AS transitivity,
       {q6('avg_shortest_path_length')} AS avg_shortest_path_length, diameter, radius,
       {q6('avg_eccentricity')} AS avg_eccentricity, shortest_path_length,
       {q6('r')} AS degree_assortativity, {q6('k')} AS avg_neighbor_degree
     FROM sz JOIN (SELECT layer, count(*) AS n_components, max(size) AS largest_component_size,
         count(*) = 1 AS is_connected FROM cs GROUP BY 1) USING (layer)
     JOIN cl USING (layer) LEFT JOIN pt USING (layer)
     LEFT JOIN as_ USING (layer) JOIN an USING (layer)""",
)
def r3(spark, d):
    """The relational part of the summary; r3_full_summary adds the kernels."""
    nodes, edges = _networks(spark, d, NetworkKind.TERM_BY_ISSUER)
    rows = R.residual_summary(nodes, edges)
    return rounded(rows.drop("modularity", "n_cliques", "spectral_radius"), *_SUMMARY)


@query("r3_full_summary")
def r3_full(spark, d):
    return rounded(
        R.residual_summary(*_networks(spark, d)), *_SUMMARY, "modularity", "spectral_radius"
    )


@query(
    "r4_coverage",
    with_(CURVE)
    + """SELECT source AS issuer, min(date) AS min_date, max(date) AS max_date, count(*) AS n_obs,
           CAST(max(date) - min(date) AS BIGINT) AS coverage_days FROM curve GROUP BY 1""",
)
def r4(spark, d):
    return R.coverage(curve(spark, d))


@query("r5_chart_columns")
def r5(spark, d):
    from stratanet.operators.metrics import size_summary

    nodes, edges = _networks(spark, d)
    return R.chart_columns(size_summary(nodes, edges, ("label",)))


# -- two models side by side ----------------------------------------------------------

BOTH_MODELS = (
    *AFNS_FIT,
    """res AS (SELECT 'ns' AS model, source AS issuer, date, term, residual FROM fr
      UNION ALL SELECT 'afns/per_issuer', source, date, term, residual FROM fr2)""",
)


def _fits(spark, d):
    return M.fit_all(curve(spark, d), SPECS)


def _stacked(spark, d):
    return cut_lineage(M.stacked_residuals(_fits(spark, d)))


@query(
    "r6_residual_size",
    with_(*BOTH_MODELS)
    + f"""SELECT model, term, {years('term')} AS maturity_years, count(*) AS n_obs,
            {q6('sqrt(avg(residual * residual)) * 10000')} AS rmse,
            {q6('avg(abs(residual)) * 10000')} AS mae FROM res GROUP BY 1, 2""",
)
def r6_size(spark, d):
    size = M.in_basis_points(M.residual_size(_stacked(spark, d)), "rmse", "mae")
    return rounded(size, "rmse", "mae")


_ACF = (
    """ctr AS (SELECT model, issuer, term, date,
      residual - avg(residual) OVER (PARTITION BY model, issuer, term) AS c FROM res)""",
    "lgd AS (SELECT *, "
    + ", ".join(
        f"c * lag(c, {k}) OVER (PARTITION BY model, issuer, term ORDER BY date) AS p{k}"
        for k in range(1, LAGS + 1)
    )
    + " FROM ctr)",
    "ac AS (SELECT model, issuer, term, count(*) AS n, "
    + ", ".join(
        f"CASE WHEN count(*) >= {max(3 * LAGS, 12)} AND sum(c * c) > 0"
        f" THEN coalesce(sum(p{k}), 0) / sum(c * c) END AS acf_{k}"
        for k in range(1, LAGS + 1)
    )
    + " FROM lgd GROUP BY 1, 2, 3)",
    "lb AS (SELECT *, n * (n + 2.0) * ("
    + " + ".join(f"acf_{k} * acf_{k} / (n - {k})" for k in range(1, LAGS + 1))
    + ") AS q FROM ac)",
    "ma AS (SELECT model, term, "
    + ", ".join(f"avg(acf_{k}) AS acf_{k}" for k in range(1, LAGS + 1))
    + ", avg(q) AS q FROM lb GROUP BY 1, 2)",
)
_LAG_NAMES = [f"acf_{k}" for k in range(1, LAGS + 1)]


def _acf(spark, d):
    return M.mean_acf(M.series_acf(_stacked(spark, d), LAGS), LAGS)


@query(
    "r7_autocorrelation",
    with_(*BOTH_MODELS, *_ACF)
    + "SELECT model, term, "
    + ", ".join(f"{q6(c)} AS {c}" for c in _LAG_NAMES)
    + " FROM ma",
)
def r7(spark, d):
    return rounded(_acf(spark, d), *_LAG_NAMES).drop("q", "ljung_box_p")


@query(
    "r8_ljung_box_q",
    with_(*BOTH_MODELS, *_ACF) + f"SELECT model, issuer, term, n, {q6('q')} AS q FROM lb",
)
def r8(spark, d):
    acf = M.series_acf(_stacked(spark, d), LAGS)
    return acf.select("model", "issuer", "term", "n", r6("q").alias("q"))


@query("r8_ljung_box_p")
def r8_p(spark, d):
    return _acf(spark, d).select("model", "term", r6("ljung_box_p").alias("ljung_box_p"))


_DIAG = """dg9 AS (SELECT 'ns' AS model, 0.0 AS s11, 0.0 AS s22, 0.0 AS s33, 0.0 AS adj,
    (SELECT avg(r) FROM (SELECT source, avg(rmse) AS r FROM fa GROUP BY 1)) AS mean_rmse
  UNION ALL SELECT 'afns/per_issuer', (SELECT avg(sqrt(s11)) FROM sg),
    (SELECT avg(sqrt(s22)) FROM sg), (SELECT avg(sqrt(s33)) FROM sg),
    (SELECT max(abs(adjustment)) FROM aj),
    (SELECT avg(r) FROM (SELECT source, avg(m) AS r FROM (SELECT source, date,
       sqrt(avg(residual * residual)) AS m FROM fr2 GROUP BY 1, 2) GROUP BY 1)))"""


@query(
    "r9_fit_diagnostics",
    with_(*BOTH_MODELS, _DIAG)
    + f"""SELECT model, (SELECT count(*) FROM sg) AS n_issuers, {q6('s11')} AS sigma_11, {q6('s22')} AS sigma_22,
            {q6('s33')} AS sigma_33, {q6('mean_rmse')} AS mean_rmse,
            {q6('adj')} AS max_abs_adjustment, CAST(1 AS DOUBLE) AS yield_scale FROM dg9""",
)
def r9(spark, d):
    rows = M.fit_diagnostics(_fits(spark, d))
    rows = rounded(
        rows, "sigma_11", "sigma_22", "sigma_33", "mean_rmse", "max_abs_adjustment"
    )
    return rows.select(
        "model", "n_issuers", "sigma_11", "sigma_22", "sigma_33", "mean_rmse",
        "max_abs_adjustment", "yield_scale",
    )


@query("r9_mean_reversion_eigenvalues")
def r9_eig(spark, d):
    rows = M.fit_diagnostics(_fits(spark, d))
    return rows.select("model", "n_iterations", "sigma_converged", "kappa_eig_1", "kappa_eig_2", "kappa_eig_3")


@query(
    "r10_cell_agreement",
    with_(*BOTH_MODELS)
    + f"""SELECT a.model AS model_a, b.model AS model_b, {q6('corr(a.residual, b.residual)')} AS residual_corr,
            {q6('avg(abs(a.residual - b.residual)) * 10000')} AS mean_abs_diff_bp
          FROM res a JOIN res b USING (issuer, date, term)
          WHERE a.model = 'ns' AND b.model <> 'ns' GROUP BY 1, 2""",
)
def r10(spark, d):
    both = M.cell_agreement(_stacked(spark, d), PAIR)
    return both.select(
        "model_a", "model_b", r6("residual_corr").alias("residual_corr"),
        r6(F.col("mean_abs_diff") * 1e4).alias("mean_abs_diff_bp"),
    )


@query(
    "j9_shared_cells",
    with_(*BOTH_MODELS)
    + """SELECT issuer, term, count(*) AS n_shared FROM res a JOIN res b USING (issuer, date, term)
         WHERE a.model = 'ns' AND b.model <> 'ns' GROUP BY 1, 2""",
)
def j9(spark, d):
    stacked = _stacked(spark, d)
    cell = ["issuer", "date", "term"]
    left = stacked.where("model = 'ns'").select(*cell)
    right = stacked.where("model <> 'ns'").select(*cell)
    return left.join(right, cell).groupBy("issuer", "term").agg(F.count(F.lit(1)).alias("n_shared"))


_EDGE_SETS = (
    *network_sql("(SELECT *, 'ns:' || term AS lb, issuer AS nn FROM res WHERE model = 'ns'"
                 " UNION ALL SELECT *, 'af:' || term, issuer FROM res WHERE model <> 'ns')",
                 "lb", "nn"),
    """eu AS (SELECT coalesce(split_part(a.layer, ':', 2), split_part(b.layer, ':', 2)) AS label,
        a.src IS NOT NULL AS ina, b.src IS NOT NULL AS inb
      FROM (SELECT * FROM ed WHERE layer LIKE 'ns:%') a
      FULL JOIN (SELECT * FROM ed WHERE layer LIKE 'af:%') b
        ON split_part(a.layer, ':', 2) = split_part(b.layer, ':', 2)
        AND a.src = b.src AND a.dst = b.dst),
    jc AS (SELECT l.label, count(*) FILTER (ina AND inb) / CAST(nullif(count(ina), 0) AS DOUBLE) AS j,
        count(*) FILTER (ina) AS na, count(*) FILTER (inb) AS nb
      FROM (SELECT DISTINCT term AS label FROM res) l LEFT JOIN eu USING (label) GROUP BY 1)""",
)


def _edge_agreement(spark, d):
    nodes, edges = R.residual_networks(
        _stacked(spark, d), NetworkKind.ISSUER_BY_TERM, T, ("model",)
    )
    return M.edge_agreement(nodes, cut_lineage(edges), PAIR)


_NAMES = "'ns' AS model_a, 'afns/per_issuer' AS model_b"


@query(
    "r10_edge_agreement",
    with_(*BOTH_MODELS, *_EDGE_SETS)
    + f"SELECT {_NAMES}, label, {q6('j')} AS edge_jaccard, na AS n_edges_a, nb AS n_edges_b FROM jc",
)
def r10_edges(spark, d):
    return rounded(_edge_agreement(spark, d), "edge_jaccard")


@query("r11_compare_models")
def r11(spark, d):
    frames = M.compare_models(curve(spark, d), SPECS, threshold=T, lags=LAGS)
    return rounded(frames["summary"], "rmse_all", "rmse_long", "rmse_short", "mean_abs_acf1")


@query(
    "r12_summary",
    with_(
        *BOTH_MODELS, *_ACF,
        f"""sz6 AS (SELECT model, term, {years('term')} AS y, count(*) AS n,
              sqrt(avg(residual * residual)) AS rmse FROM res GROUP BY 1, 2)""",
    )
    + f"""SELECT model, {q6('avg(rmse) * 10000')} AS rmse_all,
            {q6('avg(CASE WHEN y >= 15 THEN rmse END) * 10000')} AS rmse_long,
            {q6('avg(CASE WHEN y <= 2 THEN rmse END) * 10000')} AS rmse_short,
            CAST(sum(sz6.n) AS BIGINT) AS n_obs, {q6('avg(abs(acf_1))')} AS mean_abs_acf1
          FROM sz6 JOIN ma USING (model, term) GROUP BY 1""",
)
def r12(spark, d):
    fits = _fits(spark, d)
    stacked = cut_lineage(M.stacked_residuals(fits))
    acf = M.mean_acf(M.series_acf(stacked, LAGS), LAGS)
    rows = M.summarize(M.residual_size(stacked), acf, M.fit_diagnostics(fits))
    rows = M.in_basis_points(rows, "rmse_all", "rmse_long", "rmse_short")
    columns = ["rmse_all", "rmse_long", "rmse_short", "mean_abs_acf1"]
    return rounded(rows, *columns).select(
        "model", "rmse_all", "rmse_long", "rmse_short", "n_obs", "mean_abs_acf1"
    )


@query(
    "r13_mean_adjustment",
    with_(*BOTH_MODELS)
    + f"""SELECT 'afns/per_issuer' AS model, years AS maturity_years, {q6('avg(adjustment)')} AS adjustment
          FROM aj GROUP BY 1, 2 UNION ALL SELECT DISTINCT 'ns', years, CAST(0 AS DOUBLE) FROM aj""",
)
def r13(spark, d):
    return rounded(M.mean_adjustment(_fits(spark, d)), "adjustment")


@query(
    "r14_acf_long",
    with_(*BOTH_MODELS, *_ACF)
    + " UNION ALL ".join(
        f"SELECT model, term, {k} AS lag, {q6(f'acf_{k}')} AS acf FROM ma"
        for k in range(1, LAGS + 1)
    ),
)
def r14(spark, d):
    return rounded(M.acf_long(_acf(spark, d), LAGS), "acf")


@query(
    "r15_agreement_summary",
    with_(*BOTH_MODELS, *_EDGE_SETS)
    + f"""SELECT {_NAMES}, {q6('min(j)')} AS min_jaccard, {q6('avg(j)')} AS mean_jaccard,
            {q6('max(j)')} AS max_jaccard, count(*) FILTER (j < 0.999) AS n_layers_differ FROM jc""",
)
def r15(spark, d):
    rows = M.agreement_summary(_edge_agreement(spark, d))
    return rounded(rows, "min_jaccard", "mean_jaccard", "max_jaccard")


@query("r16_spec_expansion")
def r16(spark, d):
    """Residual size of every model, scope and decay of a sweep."""
    specs = M.expand_specs(["ns", "afns"], ["per_issuer", "pooled"], [1.0, 2.0], dt=DT)
    fits = M.fit_all(curve(spark, d), specs)
    return rounded(M.residual_size(M.stacked_residuals(fits)), "rmse", "mae")
