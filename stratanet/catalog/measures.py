"""J and M: pairing and dependence measures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stratanet.catalog.base import query, r6, r6_of_many
from stratanet.catalog.sql import CORR, EVENT, NET, RETURNS, SUPPLIER, pair_rows, with_
from stratanet.catalog.sql import r6 as q6
from stratanet.operators import panel as P
from stratanet.operators.pairs import MEASURES, Roles, measure_pairs, register_measure, register_pair_kernel
from stratanet.sources import adapters as A

ROLES = Roles()


def measured(panel, measure, roles=ROLES, **settings):
    pairs = measure_pairs(panel, measure, roles, **settings)
    return pairs.withColumn("measure", r6_of_many("measure"))


def returns(spark, d):
    return P.daily_returns(A.net_long(spark, d), ROLES)


RET_PAIRS = with_(NET, RETURNS, pair_rows("ret"))


def _pairs_sql(head: str, value: str, source: str = "pr") -> str:
    return head + (
        f"SELECT layer, node_i, node_j, count(*) AS n_obs, {q6(value)} AS measure"
        f" FROM {source} GROUP BY 1, 2, 3"
    )


@query("m1_pearson_pairs", _pairs_sql(RET_PAIRS, CORR))
def m1(spark, d):
    return measured(returns(spark, d), "pearson_correlation")


@query("m1_pearson_sparse", _pairs_sql(with_(EVENT, pair_rows("net")), CORR))
def m1_sparse(spark, d):
    """Users by day: most pairs share few days, many fewer than three."""
    return measured(A.event_long(spark, d), "pearson_correlation")


def _avg_rank(c: str) -> str:
    return (
        f"rank() OVER (PARTITION BY layer, node_i, node_j ORDER BY {c})"
        f" + (count(*) OVER (PARTITION BY layer, node_i, node_j, {c}) - 1) / 2.0"
    )


_RANKED = f"rk AS (SELECT layer, node_i, node_j, {_avg_rank('x')} AS x, {_avg_rank('y')} AS y FROM pr)"


@query("m2_spearman_pairs", _pairs_sql(RET_PAIRS.rstrip() + ",\n" + _RANKED + "\n", CORR, "rk"))
def m2(spark, d):
    return measured(returns(spark, d), "spearman_correlation")


@query(
    "m2_spearman_sparse",
    _pairs_sql(with_(EVENT, pair_rows("net"), _RANKED), CORR, "rk"),
)
def m2_sparse(spark, d):
    return measured(A.event_long(spark, d), "spearman_correlation")


_SIGNS = """sg AS (
  SELECT a.layer, a.node_i, a.node_j, sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy
  FROM pr a JOIN pr b ON a.layer = b.layer AND a.node_i = b.node_i
    AND a.node_j = b.node_j AND a.dt > b.dt),
tau AS (
  SELECT layer, node_i, node_j, abs(sum(sx * sy)) AS s, sum(abs(sx)) AS fx,
         sum(abs(sy)) AS fy FROM sg GROUP BY 1, 2, 3),
sz AS (SELECT layer, node_i, node_j, count(*) AS n_obs FROM pr GROUP BY 1, 2, 3)"""


@query(
    "m3_kendall_pairs",
    RET_PAIRS.rstrip()
    + ",\n"
    + _SIGNS
    + f"""
SELECT layer, node_i, node_j, n_obs, {q6('CASE WHEN n_obs >= 3 AND fx > 0 AND fy > 0 THEN s / sqrt(CAST(fx AS DOUBLE) * fy) END')} AS measure
FROM sz LEFT JOIN tau USING (layer, node_i, node_j)""",
)
def m3(spark, d):
    return measured(returns(spark, d), "kendall_tau")


_DCOV = """cross_rows AS (
  SELECT a.layer, a.node_i, a.node_j, a.dt AS s, abs(a.x - b.x) AS ax, abs(a.y - b.y) AS ay
  FROM pr a JOIN pr b ON a.layer = b.layer AND a.node_i = b.node_i AND a.node_j = b.node_j),
row_means AS (
  SELECT layer, node_i, node_j, s, avg(ax) AS mx, avg(ay) AS my, count(*) AS n,
         sum(ax * ay) AS xy, sum(ax * ax) AS xx, sum(ay * ay) AS yy
  FROM cross_rows GROUP BY 1, 2, 3, 4),
dc AS (
  SELECT layer, node_i, node_j, count(*) AS n_obs,
    sum(xy) / (count(*) * count(*)) - 2 * avg(mx * my) + avg(mx) * avg(my) AS cxy,
    sum(xx) / (count(*) * count(*)) - 2 * avg(mx * mx) + avg(mx) * avg(mx) AS cxx,
    sum(yy) / (count(*) * count(*)) - 2 * avg(my * my) + avg(my) * avg(my) AS cyy
  FROM row_means GROUP BY 1, 2, 3)"""


@query(
    "m4_distance_correlation_pairs",
    RET_PAIRS.rstrip()
    + ",\n"
    + _DCOV
    + f"""
SELECT layer, node_i, node_j, n_obs,
  {q6('CASE WHEN n_obs >= 3 THEN CASE WHEN cxx * cyy > 0 THEN sqrt(greatest(cxy, 0) / sqrt(cxx * cyy)) ELSE 0.0 END END')} AS measure
FROM dc""",
)
def m4(spark, d):
    return measured(returns(spark, d), "distance_correlation")


_XI = f"""xr AS (
  SELECT layer, node_i, node_j, x, dt, {_avg_rank('y')} AS ry FROM pr),
xd AS (
  SELECT layer, node_i, node_j, abs(ry - lag(ry) OVER (
    PARTITION BY layer, node_i, node_j ORDER BY x, dt)) AS step FROM xr)"""


@query(
    "m5_chatterjee_xi_pairs",
    _pairs_sql(
        RET_PAIRS.rstrip() + ",\n" + _XI + "\n",
        "CASE WHEN count(*) >= 3 THEN abs(1.0 - 3.0 * sum(step)"
        " / (CAST(count(*) AS DOUBLE) * count(*) - 1.0)) END",
        "xd",
    ),
)
def m5(spark, d):
    return measured(returns(spark, d), "chatterjee_xi")


def _conditional(q: float) -> str:
    cut = f"""cut AS (SELECT layer, node, quantile_cont(abs(value), {q}) AS c FROM ret GROUP BY 1, 2),
hot AS (SELECT ret.* FROM ret JOIN cut USING (layer, node) WHERE abs(value) > c)"""
    return _pairs_sql(
        with_(NET, RETURNS, cut, pair_rows("hot")),
        f"({CORR} + 1.0) / 2.0",
    )


@query("m6_conditional_pairs", _conditional(0.9))
def m6(spark, d):
    return measured(returns(spark, d), "conditional_correlation")


@query("m6_conditional_quantile", _conditional(0.5))
def m6_half(spark, d):
    return measured(returns(spark, d), "conditional_correlation", quantile=0.5)


_SHRINK = """want AS (SELECT layer, count(DISTINCT node) AS w FROM ret GROUP BY 1),
full_dates AS (
  SELECT layer, dt FROM ret JOIN want USING (layer) GROUP BY layer, dt, w HAVING count(*) = w),
lw AS (
  SELECT layer, node, dt, value - avg(value) OVER (PARTITION BY layer, node) AS v
  FROM ret JOIN full_dates USING (layer, dt)),
g AS (
  SELECT a.layer, a.node AS node_i, b.node AS node_j, count(*) AS n, sum(a.v * b.v) AS s,
         sum(a.v * a.v) AS si, sum(b.v * b.v) AS sj, sum(a.v * a.v * b.v * b.v) AS s4
  FROM lw a JOIN lw b ON a.layer = b.layer AND a.dt = b.dt GROUP BY 1, 2, 3),
tot AS (
  SELECT layer, max(n) AS n, count(*) FILTER (node_i = node_j) AS p,
         sum(s / n) FILTER (node_i = node_j) AS tr, sum(s4) AS x4,
         sum((s / n) * (s / n)) AS s2 FROM g GROUP BY 1),
wt AS (
  SELECT layer, tr / p AS mu, (s2 - tr * tr / p) / p AS dl,
         (x4 / n - s2) / (p * n) AS bt FROM tot),
al AS (SELECT layer, mu, CASE WHEN least(bt, dl) > 0 THEN least(bt, dl) / dl ELSE 0 END AS a FROM wt)"""


@query(
    "m7_shrinkage_pairs",
    with_(NET, RETURNS, _SHRINK)
    + f"""SELECT layer, node_i, node_j, n AS n_obs,
  {q6('((1 - a) * s / n / sqrt(((1 - a) * si / n + a * mu) * ((1 - a) * sj / n + a * mu)) + 1) / 2')} AS measure
FROM g JOIN al USING (layer) WHERE node_i < node_j AND n >= 2""",
)
def m7(spark, d):
    return measured(returns(spark, d), "shrinkage_correlation")


@query("m1_pearson_suppliers", _pairs_sql(with_(SUPPLIER, pair_rows("net")), CORR))
def m1_suppliers(spark, d):
    """One node per supplier: the wide panel."""
    return measured(A.supplier_long(spark, d), "pearson_correlation")


@query("m2_spearman_suppliers", _pairs_sql(with_(SUPPLIER, pair_rows("net"), _RANKED), CORR, "rk"))
def m2_suppliers(spark, d):
    return measured(A.supplier_long(spark, d), "spearman_correlation")


def same_sign(x, Y):
    """Share of common dates on which both series have the same sign."""
    both = ~np.isnan(x)[:, None] & ~np.isnan(Y)
    n = both.sum(axis=0)
    agree = ((np.sign(x)[:, None] == np.sign(Y)) & both).sum(axis=0)
    return np.where(n > 0, agree / np.maximum(n, 1), np.nan), n


@query("u2_registered_kernel", _pairs_sql(RET_PAIRS, "avg(CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END)"))
def u2_kernel(spark, d):
    """A measure of the caller's own, given as a kernel."""
    register_pair_kernel("same_sign", same_sign, label="Same sign")
    return measured(returns(spark, d), "same_sign")


def smaller_mean(panel, roles):
    """The lesser of two nodes' mean absolute values, over all their dates."""
    size = panel.groupBy(*roles.keys, roles.node).agg(F.avg(F.abs(roles.value)).alias("_size"), F.count(F.lit(1)).alias("_n"))
    a = size.withColumnsRenamed({roles.node: "node_i", "_size": "_a", "_n": "_na"})
    b = size.withColumnsRenamed({roles.node: "node_j", "_size": "_b", "_n": "_nb"})
    return a.join(b, list(roles.keys)).where("node_i < node_j").select(
        *roles.keys, "node_i", "node_j", F.least("_na", "_nb").alias("n_obs"), F.least("_a", "_b").alias("measure")
    )


@query(
    "u2_registered_measure",
    with_(NET, RETURNS)
    + f"""SELECT a.layer, a.node AS node_i, b.node AS node_j, least(a.n, b.n) AS n_obs, {q6('least(a.s, b.s)')} AS measure
          FROM (SELECT layer, node, avg(abs(value)) AS s, count(*) AS n FROM ret GROUP BY 1, 2) a
          JOIN (SELECT layer, node, avg(abs(value)) AS s, count(*) AS n FROM ret GROUP BY 1, 2) b
            ON a.layer = b.layer AND a.node < b.node""",
)
def u2_measure(spark, d):
    """A measure of the caller's own, given as DataFrame work."""
    register_measure("smaller_mean", smaller_mean)
    return measured(returns(spark, d), "smaller_mean")


#: Each point's third nearest other one by the larger of both gaps, and the points nearer than it along each axis.
_INFORMATION = """sp AS (SELECT layer, node, stddev_pop(value) AS s FROM ret GROUP BY 1, 2),
pp AS (SELECT * FROM pr UNION ALL SELECT layer, node, node, dt, value, value FROM ret),
sd AS (SELECT layer, node_i, node_j, count(*) AS n, stddev_pop(x) AS sx, stddev_pop(y) AS sy FROM pp GROUP BY 1, 2, 3),
sc AS MATERIALIZED (SELECT layer, node_i, node_j, n, dt, x / CASE WHEN sx > 0 THEN sx ELSE 1 END AS x, y / CASE WHEN sy > 0 THEN sy ELSE 1 END AS y
  FROM pp JOIN sd USING (layer, node_i, node_j) WHERE n > 3),
gp AS MATERIALIZED (SELECT a.layer, a.node_i, a.node_j, a.n, a.dt, abs(a.x - b.x) AS gx, abs(a.y - b.y) AS gy
  FROM sc a JOIN sc b ON a.layer = b.layer AND a.node_i = b.node_i AND a.node_j = b.node_j AND a.dt <> b.dt),
th AS (SELECT layer, node_i, node_j, dt, list_sort(list(greatest(gx, gy)))[3] AS r FROM gp GROUP BY 1, 2, 3, 4),
ct AS (SELECT layer, node_i, node_j, dt, any_value(n) AS n, count(*) FILTER (gx < r) AS na, count(*) FILTER (gy < r) AS nb
  FROM gp JOIN th USING (layer, node_i, node_j, dt) GROUP BY 1, 2, 3, 4),
hm AS (SELECT k, sum(CASE WHEN k = 0 THEN 0.0 ELSE 1.0 / k END) OVER (ORDER BY k) AS h FROM (SELECT unnest(range(0, 2000)) AS k)),
mi AS (SELECT layer, node_i, node_j, greatest(0.0, any_value(hn.h) + 1.5 - avg(ha.h) - avg(hb.h)) AS raw FROM ct
  JOIN hm hn ON hn.k = n - 1 JOIN hm ha ON ha.k = na JOIN hm hb ON hb.k = nb GROUP BY 1, 2, 3),
pk AS (SELECT layer, greatest(1e-6, max(raw)) AS peak FROM mi GROUP BY 1)"""


@query(
    "m8_mutual_information_pairs",
    with_(NET, RETURNS, pair_rows("ret"), _INFORMATION)
    + f"""SELECT sd.layer, node_i, node_j, n AS n_obs, {q6('least(1.0, raw / peak)')} AS measure
          FROM sd LEFT JOIN mi USING (layer, node_i, node_j) LEFT JOIN pk ON pk.layer = sd.layer WHERE node_i < node_j""",
)
def m8(spark, d):
    return measured(returns(spark, d), "mutual_information")


@query("m9_dtw_pairs")
def m9(spark, d):
    return measured(returns(spark, d), "dtw_distance")


@query("m10_banded_dtw_pairs")
def m10(spark, d):
    return measured(returns(spark, d), "fastdtw_distance", radius=3)


@query("m11_maximal_correlation_pairs")
def m11(spark, d):
    return measured(returns(spark, d), "maximal_correlation")


@query(
    "m12_measure_range",
    RET_PAIRS
    + f"""SELECT layer, CAST(-1 AS DOUBLE) AS low, CAST(1 AS DOUBLE) AS high, {q6('min(m)')} AS min_measure, {q6('max(m)')} AS max_measure
FROM (SELECT layer, node_i, node_j, {CORR} AS m FROM pr GROUP BY 1, 2, 3) GROUP BY 1""",
)
def m12(spark, d):
    """Threshold range of a measure next to the values it takes."""
    meta = MEASURES["pearson_correlation"]
    return (
        measure_pairs(returns(spark, d), "pearson_correlation")
        .groupBy("layer")
        .agg(
            F.lit(meta.low).alias("low"),
            F.lit(meta.high).alias("high"),
            r6(F.min("measure")).alias("min_measure"),
            r6(F.max("measure")).alias("max_measure"),
        )
    )


@query(
    "j6_pair_counts",
    with_(EVENT, pair_rows("net"))
    + "SELECT layer, node_i, node_j, count(*) AS n_obs FROM pr GROUP BY 1, 2, 3",
)
def j6(spark, d):
    """Common dates of every pair, from the tiled pairing."""
    from stratanet.operators.pairs import pair_totals
    from stratanet.session import written

    days = written(A.event_long(spark, d).withColumn("value", F.lit(1.0)), "days")
    return pair_totals(days, ROLES, counts=True).select("layer", "node_i", "node_j", F.col("n").alias("n_obs"))
