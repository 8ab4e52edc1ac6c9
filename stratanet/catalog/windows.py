"""W1–W6: windows and windowed networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratanet.catalog.base import query, r6, rounded
from stratanet.catalog.graphs import (
    _DENS, BOTH, CENT, PATHS, PM, REACH, SIZES, TRI, recursive,
)
from stratanet.catalog.measures import _RANKED, ROLES, returns
from stratanet.catalog.sql import CORR, NET, RETURNS, pair_rows, with_
from stratanet.catalog.sql import r6 as q6
from stratanet.operators import evolution as E
from stratanet.operators import metrics as H
from stratanet.operators import windows as W
from stratanet.session import cut_lineage
from stratanet.sources import adapters as A

ROLLING = W.Schedule(24, 6)
EXPANDING = W.Schedule(24, 12, expanding=True)
T = 0.4


def window_sql(source: str, s: W.Schedule, date: str = "dt") -> str:
    start = "0" if s.expanding else f"k * {s.step}"
    return f"""dx AS (SELECT {date} AS dt, row_number() OVER (ORDER BY {date}) - 1 AS t
  FROM (SELECT DISTINCT {date} FROM {source})),
kx AS (SELECT unnest(range(0, CAST(floor((n - {s.size}) / {s.step}.0) AS BIGINT) + 1)) AS k
  FROM (SELECT count(*) AS n FROM dx)),
ww AS (SELECT k AS window_idx, a.dt AS date_start, b.dt AS date_end
  FROM kx JOIN dx a ON a.t = {start} JOIN dx b ON b.t = k * {s.step} + {s.size} - 1)"""


for _name, _s in (("w1_windows", ROLLING), ("w1_expanding_windows", EXPANDING)):

    @query(_name, with_(NET, window_sql("net", _s)) + "SELECT * FROM ww")
    def w1(spark, d, s=_s):
        index = W.date_index(A.net_long(spark, d), "dt")
        return W.window_table(index, "dt", s)


@query(
    "x2_window_membership",
    with_(NET, window_sql("net", ROLLING))
    + """SELECT window_idx, layer, count(*) AS n_rows FROM net
         JOIN ww ON dt BETWEEN date_start AND date_end GROUP BY 1, 2""",
)
def x2(spark, d):
    rows = W.assign_windows(A.net_long(spark, d), "dt", ROLLING)
    return rows.groupBy("window_idx", "layer").agg(F.count(F.lit(1)).alias("n_rows"))


def _windowed_pairs_sql(s):
    return (
        with_(
            NET, RETURNS, window_sql("ret", s),
            """wr AS (SELECT window_idx || ':' || layer AS layer, dt, node, value
               FROM ret JOIN ww ON dt BETWEEN date_start AND date_end)""",
            pair_rows("wr"),
        )
        + f"""SELECT layer AS graph, node_i, node_j, count(*) AS n_obs,
              {q6(CORR)} AS measure FROM pr GROUP BY 1, 2, 3"""
    )


def _graph_label():
    return F.concat_ws(":", F.col("window_idx").cast("string"), "layer").alias("graph")


for _name, _s in (("w2_window_pairs", ROLLING), ("w2_expanding_pairs", EXPANDING)):

    @query(_name, _windowed_pairs_sql(_s))
    def w2_pairs(spark, d, s=_s):
        """Every pair in every window, from sums per block of dates."""
        bounded = W.bounded_rows(returns(spark, d), "dt", s)
        pairs = W.windowed_pearson(bounded, ROLES)
        return pairs.select(_graph_label(), "node_i", "node_j", "n_obs", r6("measure").alias("measure"))


#: Levels that jump by 1e5 every eight months, with the ordinary scatter on top.
STEPPED = """stp AS (SELECT layer, node, dt,
  value + 100000.0 * floor((year(dt) * 12 + month(dt)) / 8.0) AS value FROM net)"""


for _name, _s in (("w2_stepped_pairs", W.Schedule(6, 3)), ("w2_stepped_expanding", EXPANDING)):

    @query(
        _name,
        with_(
            NET, STEPPED, window_sql("stp", _s),
            """wr AS (SELECT window_idx || ':' || layer AS layer, dt, node, value
               FROM stp JOIN ww ON dt BETWEEN date_start AND date_end)""",
            pair_rows("wr"),
        )
        + f"""SELECT layer AS graph, node_i, node_j, count(*) AS n_obs,
              {q6(CORR)} AS measure FROM pr GROUP BY 1, 2, 3""",
    )
    def w2_stepped(spark, d, s=_s):
        """Pairs of series whose level jumps far above their scatter."""
        month = F.year("dt") * 12 + F.month("dt")
        panel = A.net_long(spark, d).withColumn("value", F.col("value") + 100000.0 * F.floor(month / 8.0))
        pairs = W.windowed_pearson(W.bounded_rows(panel, "dt", s), ROLES)
        return pairs.select(_graph_label(), "node_i", "node_j", "n_obs", r6("measure").alias("measure"))


_EVOLUTION = (
    NET, RETURNS, window_sql("ret", ROLLING),
    """wr AS (SELECT * FROM (SELECT window_idx || ':' || layer AS layer, dt, node, value,
         count(*) OVER (PARTITION BY window_idx, layer, node) AS nv
       FROM ret JOIN ww ON dt BETWEEN date_start AND date_end) WHERE nv >= 3)""",
    pair_rows("wr"), PM,
    f"""nd AS (SELECT DISTINCT layer, node FROM wr),
ed AS (SELECT layer, node_i AS src, node_j AS dst, 1 - coalesce(m, 0) AS weight,
         coalesce(m, 0) AS strength FROM pm WHERE round(coalesce(m, 0), 9) >= {T})""",
)


@query(
    "w2_window_networks",
    recursive(with_(*_EVOLUTION, BOTH, SIZES, REACH, TRI, PATHS))
    + f"""SELECT layer AS graph, n_nodes, n_edges, {q6(_DENS + ' ELSE 0.0 END')} AS density,
            {q6('2.0 * n_edges / n_nodes')} AS avg_degree, n_components,
            largest_component_size, {q6('avg_clustering')} AS avg_clustering,
            {q6('transitivity')} AS transitivity,
            {q6('avg_shortest_path_length')} AS avg_shortest_path_length
          FROM sz JOIN (SELECT layer, count(*) AS n_components,
              max(size) AS largest_component_size FROM cs GROUP BY 1) USING (layer)
          JOIN cl USING (layer) LEFT JOIN pt USING (layer)""",
)
def w2(spark, d):
    nodes, edges = E.evolution_graphs(returns(spark, d), ROLLING, threshold=T, roles=ROLES)
    rows = H.network_summary(nodes, edges, ("window_idx", "layer"))
    rows = rounded(
        rows, "density", "avg_degree", "avg_clustering", "transitivity", "avg_shortest_path_length"
    )
    return rows.select(
        _graph_label(), "n_nodes", "n_edges", "density", "avg_degree", "n_components",
        "largest_component_size", "avg_clustering", "transitivity", "avg_shortest_path_length",
    )


_METRICS = """mt AS (SELECT layer, node, 'weighted_degree' AS metric, weighted_degree AS value FROM dg
  UNION ALL SELECT layer, node, 'degree', value FROM dc)"""


_WINDOWED = """wr AS (SELECT window_idx || ':' || layer AS layer, node, dt, value FROM ret
  JOIN ww ON dt BETWEEN date_start AND date_end),
wn AS (SELECT layer, node FROM wr GROUP BY 1, 2 HAVING count(*) >= 3),
we AS (SELECT wr.* FROM wr JOIN wn USING (layer, node))"""


@query(
    "w2_window_spearman",
    with_(NET, RETURNS, window_sql("ret", ROLLING), _WINDOWED, pair_rows("we"), _RANKED)
    + f"""SELECT layer AS graph, node_i, node_j, count(*) AS n_obs, {q6(CORR)} AS measure
          FROM rk GROUP BY 1, 2, 3""",
)
def w2_spearman(spark, d):
    """A rank measure in every window, where rows are copied to the windows they lie in."""
    ret = returns(spark, d)
    bounded = W.bounded_rows(ret, "dt", ROLLING)
    rows = W.windowed_measure(bounded, "spearman_correlation", ROLES)
    return rows.select(_graph_label(), "node_i", "node_j", "n_obs", r6("measure").alias("measure"))


@query(
    "w2_window_node_metrics",
    with_(*_EVOLUTION, BOTH, CENT, _METRICS)
    + f"SELECT layer AS graph, node, metric, {q6('value')} AS value FROM mt",
)
def w2_nodes(spark, d):
    return _node_metrics(spark, d).select(
        _graph_label(), "node", "metric", r6("value").alias("value")
    )


def _node_metrics(spark, d):
    nodes, edges = E.evolution_graphs(returns(spark, d), ROLLING, threshold=T, roles=ROLES)
    return H.node_metric_rows(nodes, edges, ("window_idx", "layer"), "degree")


_INSIDE = """wr0 AS (SELECT window_idx, layer, node, dt, value,
    lag(value) OVER (PARTITION BY window_idx, layer, node ORDER BY dt) AS prev
  FROM net JOIN ww ON dt BETWEEN date_start AND date_end),
wr AS (SELECT window_idx, window_idx || ':' || layer AS layer, layer AS lay, node, dt,
    value / prev - 1.0 AS value FROM wr0 WHERE prev <> 0)"""
_MIX = f"""nd AS (SELECT DISTINCT window_idx, layer, lay, node FROM wr),
ed AS (SELECT CAST(split_part(layer, ':', 1) AS BIGINT) AS window_idx, layer
       FROM pm WHERE round(coalesce(m, 0), 9) >= {T}),
ia AS (SELECT window_idx, count(*) AS intra_edges FROM ed GROUP BY 1),
ie AS (SELECT a.window_idx, count(*) AS inter_edges FROM nd a JOIN nd b
       ON a.window_idx = b.window_idx AND a.node = b.node AND a.lay < b.lay GROUP BY 1),
nn AS (SELECT window_idx, count(*) AS n_nodes FROM nd GROUP BY 1)"""


@query(
    "w3_multiplex_evolution",
    with_(NET, window_sql("net", ROLLING), _INSIDE, pair_rows("wr"), PM, _MIX)
    + f"""SELECT window_idx, date_start, date_end, coalesce(intra_edges, 0) AS intra_edges,
           coalesce(inter_edges, 0) AS inter_edges,
           coalesce(intra_edges, 0) + coalesce(inter_edges, 0) AS total_edges, n_nodes,
           {q6('100.0 * coalesce(intra_edges, 0) / (coalesce(intra_edges, 0) + coalesce(inter_edges, 0))')} AS pct_intra,
           {q6('100.0 * coalesce(inter_edges, 0) / (coalesce(intra_edges, 0) + coalesce(inter_edges, 0))')} AS pct_inter
         FROM ww LEFT JOIN ia USING (window_idx) LEFT JOIN ie USING (window_idx)
         LEFT JOIN nn USING (window_idx)""",
)
def w3(spark, d):
    mix, _, _ = E.multiplex_evolution(A.net_long(spark, d), ROLLING, threshold=T)
    return rounded(mix, "pct_intra", "pct_inter")


@query(
    "j3_links_with_numbers",
    with_(NET, window_sql("net", ROLLING), _INSIDE, pair_rows("wr"), PM, _MIX)
    + """SELECT window_idx, coalesce(intra_edges, 0) + coalesce(inter_edges, 0) AS total_edges,
           CAST(window_idx % 4 + 2 AS INTEGER) AS k_FIXED, CASE WHEN window_idx % 2 = 0 THEN 7 END AS k_MODULARITY
         FROM ww LEFT JOIN ia USING (window_idx) LEFT JOIN ie USING (window_idx)""",
)
def j3(spark, d):
    """Edge mix with given numbers of communities; a method without one in a window stays empty."""
    mix, _, _ = E.multiplex_evolution(A.net_long(spark, d), ROLLING, threshold=T)
    mix = cut_lineage(mix)
    fixed = mix.select("window_idx", F.lit("FIXED").alias("method"), (F.col("window_idx") % 4 + 2).cast("int").alias("n_clusters"))
    even = mix.where("window_idx % 2 = 0").select("window_idx", F.lit("MODULARITY").alias("method"), F.lit(7).alias("n_clusters"))
    table = E.links_table(mix, fixed.unionByName(even), ["FIXED", "MODULARITY"])
    return table.select("window_idx", "total_edges", "k_FIXED", "k_MODULARITY")


_VARIES = f"""sd AS (SELECT split_part(layer, ':', 2) AS layer, node, stddev_samp(value) AS s
  FROM mt WHERE metric = 'weighted_degree' GROUP BY 1, 2)"""

for _most, _dir in ((True, "DESC"), (False, "ASC")):

    @query(
        "w4_most_variable_nodes" if _most else "w4_least_variable_nodes",
        with_(*_EVOLUTION, BOTH, CENT, _METRICS, _VARIES)
        + f"""SELECT * FROM (SELECT layer, node, {q6('s')} AS std, row_number() OVER (
                PARTITION BY layer ORDER BY s {_dir}, node) AS rank FROM sd WHERE s IS NOT NULL)
              WHERE rank <= 5""",
    )
    def w4(spark, d, most=_most):
        top = E.variable_nodes(_node_metrics(spark, d), "weighted_degree", 5, ("layer",), most)
        return rounded(top, "std")


@query(
    "w6_heatmap",
    with_(*_EVOLUTION, BOTH, CENT, _METRICS)
    + f"""SELECT layer AS graph, node, {q6('value')} AS value FROM mt
          WHERE metric = 'weighted_degree'""",
)
def w6(spark, d):
    """Cells of every window and layer."""
    rows = _node_metrics(spark, d).where("metric = 'weighted_degree'")
    cells = E.heatmap_cells(rows, ["layer", "node"], "window_idx")
    return cells.select(_graph_label(), "node", r6("value").alias("value"))


@query(
    "c9_common_nodes",
    with_(*_EVOLUTION)
    + """SELECT split_part(layer, ':', 2) AS lay, node FROM nd GROUP BY 1, 2
         HAVING count(DISTINCT layer) = (SELECT count(*) FROM ww)""",
)
def c9_common(spark, d):
    """Nodes present in every window of their layer."""
    from stratanet.operators.communities import common_nodes

    nodes, _ = E.evolution_graphs(returns(spark, d), ROLLING, threshold=T, roles=ROLES)
    common = common_nodes(nodes, ("layer",))
    return common.select(F.col("layer").alias("lay"), "node")

