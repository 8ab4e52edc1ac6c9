"""G, H and C1: graphs over the returns network."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratanet.catalog import graph_sql as S
from stratanet.catalog.base import query, r6, rounded
from stratanet.catalog.measures import ROLES, RET_PAIRS, returns
from stratanet.catalog.sql import CORR, NET
from stratanet.catalog.sql import r6 as q6
from stratanet.operators import graph as G
from stratanet.operators import metrics as H
from stratanet.operators import panel as P
from stratanet.operators.pairs import Roles, measure_pairs
from stratanet.session import cut_lineage
from stratanet.sources import adapters as A

#: Keeps the graphs of the test panel neither empty nor complete.
T = 0.15
KEYS = ("layer",)


def net_graph(spark, d, threshold=T):
    ret = cut_lineage(returns(spark, d))
    pairs = cut_lineage(measure_pairs(ret, "pearson_correlation", stored=True))
    return G.graph_nodes(ret, ROLES), G.threshold_edges(pairs, threshold), pairs


PM = f"pm AS (SELECT layer, node_i, node_j, {CORR} AS m FROM pr GROUP BY 1, 2, 3)"


def graph_sql(threshold=T, *more: str) -> str:
    ed = f"""nd AS (SELECT DISTINCT layer, node FROM ret),
ed AS (SELECT layer, node_i AS src, node_j AS dst, 1 - coalesce(m, 0) AS weight,
         coalesce(m, 0) AS strength FROM pm WHERE round(coalesce(m, 0), 9) >= {threshold})"""
    return RET_PAIRS.rstrip() + ",\n" + ",\n".join((PM, ed, *more)) + "\n"


BOTH = """bw AS (SELECT layer, src AS node, dst AS other, weight, strength FROM ed
  UNION ALL SELECT layer, dst, src, weight, strength FROM ed),
dg AS (SELECT nd.layer, nd.node, count(bw.other) AS degree,
         coalesce(sum(bw.strength), 0) AS weighted_degree
       FROM nd LEFT JOIN bw ON nd.layer = bw.layer AND nd.node = bw.node GROUP BY 1, 2)"""

EDGE_COLUMNS = f"layer, src, dst, {q6('weight')} AS weight, {q6('strength')} AS strength"


@query("g1_threshold_edges", graph_sql() + f"SELECT {EDGE_COLUMNS} FROM ed")
def g1(spark, d):
    return rounded(net_graph(spark, d)[1], "weight", "strength")


@query(
    "g2_rethreshold",
    graph_sql()
    + f"""SELECT t AS threshold, layer, node_i AS src, node_j AS dst,
            {q6('1 - coalesce(m, 0)')} AS weight
          FROM pm, (VALUES (CAST(0.1 AS DOUBLE)), (0.2), (0.3)) v(t)
          WHERE round(coalesce(m, 0), 9) >= t""",
)
def g2(spark, d):
    pairs = measure_pairs(returns(spark, d), "pearson_correlation")
    return rounded(G.sweep_thresholds(pairs, [0.1, 0.2, 0.3]), "weight")


@query(
    "g3_strength",
    graph_sql() + f"SELECT layer, src, dst, {q6('1 - weight')} AS strength FROM ed",
)
def g3(spark, d):
    edges = G.with_strength(net_graph(spark, d)[1].drop("strength"))
    return edges.select("layer", "src", "dst", r6("strength").alias("strength"))


@query(
    "g4_layer_graphs",
    graph_sql()
    + """SELECT layer, count(*) AS n_nodes,
            (SELECT count(*) FROM ed WHERE ed.layer = nd.layer) AS n_edges
         FROM nd GROUP BY layer""",
)
def g4(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return H.size_summary(nodes, edges, KEYS).select("layer", "n_nodes", "n_edges")


INTER = """it AS (SELECT a.node, a.layer AS layer_a, b.layer AS layer_b
  FROM nd a JOIN nd b ON a.node = b.node AND a.layer < b.layer)"""


@query(
    "g5_multiplex_edges",
    graph_sql(T, INTER)
    + f"""SELECT src AS u_node, layer AS u_layer, dst AS v_node, layer AS v_layer,
            {q6('strength')} AS weight, 'intra' AS edge_type FROM ed
          UNION ALL SELECT node, layer_a, node, layer_b, 1.0, 'inter' FROM it""",
)
def g5(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    _, intra, inter = G.multiplex_tables(nodes, edges)
    return G.multiplex_edges(intra, inter).select(
        F.col("u.node").alias("u_node"), F.col("u.layer").alias("u_layer"),
        F.col("v.node").alias("v_node"), F.col("v.layer").alias("v_layer"),
        r6("weight").alias("weight"), "edge_type",
    )


@query(
    "j7_inter_layer_pairs",
    graph_sql(T, INTER) + "SELECT node, layer_a, layer_b FROM it",
)
def j7(spark, d):
    return G.inter_edges(net_graph(spark, d)[0]).select("node", "layer_a", "layer_b")


@query("g6_multiplex_nodes", graph_sql() + "SELECT node AS issuer, layer AS term FROM nd WHERE layer IN ('A', 'R')")
def g6(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return G.multiplex_tables(nodes, edges, terms=["A", "R"])[0]


@query(
    "g7_filtered_inter",
    graph_sql(T, INTER)
    + """SELECT node AS source_issuer, node AS target_issuer, layer_a AS term_from,
           layer_b AS term_to, CAST(1 AS DOUBLE) AS weight
         FROM it WHERE layer_a IN ('A', 'R') AND layer_b IN ('A', 'R')""",
)
def g7(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return G.multiplex_tables(nodes, edges, terms=["A", "R"])[2]


@query("g8_available_terms", graph_sql() + "SELECT DISTINCT layer AS term FROM nd")
def g8(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return G.available_terms(G.multiplex_tables(nodes, edges)[0])


@query(
    "g9_edge_table",
    graph_sql(T, INTER)
    + f"""SELECT src AS source_issuer, dst AS target_issuer, layer AS term,
            {q6('strength')} AS weight, 'intra' AS edge_type,
            CAST(NULL AS VARCHAR) AS term_from, CAST(NULL AS VARCHAR) AS term_to FROM ed
          UNION ALL SELECT node, node, NULL, 1.0, 'inter', layer_a, layer_b FROM it""",
)
def g9(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    _, intra, inter = G.multiplex_tables(nodes, edges)
    return rounded(G.edge_table(intra, inter), "weight")


@query(
    "g10_count_edge_types",
    graph_sql(T, INTER)
    + """SELECT 'intra' AS edge_type, count(*) AS n_edges FROM ed
         UNION ALL SELECT 'inter', count(*) FROM it""",
)
def g10(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    _, intra, inter = G.multiplex_tables(nodes, edges)
    return G.count_edge_types(G.multiplex_edges(intra, inter))


@query(
    "g11_layer_edge_metrics",
    graph_sql(
        T, INTER,
        """mx AS (SELECT l.layer,
             (SELECT count(*) FROM ed WHERE ed.layer = l.layer) AS intra_edges,
             (SELECT count(*) FROM it WHERE it.layer_a = l.layer OR it.layer_b = l.layer)
               AS inter_edges
           FROM (SELECT DISTINCT layer FROM nd) l)""",
    )
    + f"""SELECT layer, intra_edges, inter_edges,
       {q6('CASE WHEN intra_edges + inter_edges > 0 THEN 100.0 * intra_edges / (intra_edges + inter_edges) ELSE 0.0 END')} AS pct_intra,
       {q6('CASE WHEN intra_edges + inter_edges > 0 THEN 100.0 * inter_edges / (intra_edges + inter_edges) ELSE 0.0 END')} AS pct_inter
       FROM mx""",
)
def g11(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    mix = G.layer_edge_metrics(nodes, edges, G.inter_edges(nodes))
    return rounded(mix, "pct_intra", "pct_inter")


@query(
    "g12_layer_subgraph",
    graph_sql(T, BOTH)
    + "SELECT node AS issuer, degree FROM dg WHERE layer = 'R'",
)
def g12(spark, d):
    """One layer read back from the multiplex tables, isolated nodes kept."""
    nodes, edges, _ = net_graph(spark, d)
    n, intra, _ = G.multiplex_tables(nodes, edges)
    n, intra = G.layer_subgraph(n, intra, "R")
    deg = G.degrees(
        n.withColumnsRenamed({"issuer": "node", "term": "layer"}),
        intra.withColumnsRenamed(
            {"source_issuer": "src", "target_issuer": "dst", "term": "layer", "weight": "strength"}
        ),
        KEYS,
    )
    return deg.select(F.col("node").alias("issuer"), "degree")


@query(
    "g13_degree",
    graph_sql(T, BOTH)
    + f"SELECT layer, node, degree, {q6('weighted_degree')} AS weighted_degree FROM dg",
)
def g13(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    table = rounded(G.degrees(nodes, edges, KEYS), "weighted_degree")
    return table.orderBy(F.desc("degree"), "layer", "node")


@query(
    "g14_degree_histogram",
    graph_sql(
        T, BOTH,
        """sp AS (SELECT layer,
             CASE WHEN min(degree) = max(degree) THEN min(degree) - 0.5 ELSE min(degree) END
               ::DOUBLE AS lo,
             CASE WHEN min(degree) = max(degree) THEN max(degree) + 0.5 ELSE max(degree) END
               ::DOUBLE AS hi FROM dg GROUP BY 1),
           bn AS (SELECT layer, lo, hi, CAST(least(14, floor((degree - lo) / ((hi - lo) / 15.0)))
               AS BIGINT) AS bin FROM dg JOIN sp USING (layer))""",
    )
    + f"""SELECT layer, bin, {q6('lo + bin * ((hi - lo) / 15.0)')} AS bin_start,
            {q6('lo + (bin + 1) * ((hi - lo) / 15.0)')} AS bin_end, count(*) AS count
          FROM bn GROUP BY layer, bin, lo, hi""",
)
def g14(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(G.degree_histogram(G.degrees(nodes, edges, KEYS)), "bin_start", "bin_end")


@query(
    "g14_degree_landmarks",
    graph_sql(
        T, BOTH,
        """pv AS (SELECT layer, degree, count(*) AS n, min(node) AS node FROM dg GROUP BY 1, 2)""",
    )
    + f"""SELECT layer, {q6('sum(degree * n) / CAST(sum(n) AS DOUBLE)')} AS mean_degree,
            min(degree) AS min_degree, max(degree) AS max_degree,
            first(degree ORDER BY n DESC, degree) AS mode_degree,
            first(node ORDER BY degree) AS min_node, first(node ORDER BY degree DESC) AS max_node,
            first(node ORDER BY n DESC, degree) AS mode_node FROM pv GROUP BY 1""",
)
def g14_landmarks(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(G.degree_landmarks(G.degrees(nodes, edges, KEYS)), "mean_degree")


@query(
    "s17_stored_multiplex",
    graph_sql(T, INTER)
    + """SELECT 'nodes' AS part, count(*) AS n_rows FROM nd
         UNION ALL SELECT 'intra', count(*) FROM ed UNION ALL SELECT 'inter', count(*) FROM it""",
)
def s17(spark, d):
    """Multiplex tables written to a store and read back without rebuilding."""
    from stratanet.session import scratch_path
    from stratanet.sources import store

    nodes, edges, _ = net_graph(spark, d)
    names = ("mln_nodes", "mln_intra", "mln_inter")
    path = scratch_path(spark, "multiplex")
    store.save_results(spark, path, dict(zip(names, G.multiplex_tables(nodes, edges), strict=True)))
    tables = store.load_multiplex(spark, path)
    return G.union_all(
        [
            t.groupBy(F.lit(n.removeprefix("mln_")).alias("part")).agg(
                F.count(F.lit(1)).alias("n_rows")
            )
            for n, t in zip(names, tables, strict=True)
        ]
    )


@query(
    "s17_loaded_intra",
    graph_sql() + f"SELECT src AS source_issuer, dst AS target_issuer, layer AS term, {q6('strength')} AS weight FROM ed",
)
def s17_rows(spark, d):
    """The rows of one multiplex table as they come back from a store."""
    from stratanet.session import scratch_path
    from stratanet.sources import store

    nodes, edges, _ = net_graph(spark, d)
    path = scratch_path(spark, "multiplex")
    names = ("mln_nodes", "mln_intra", "mln_inter")
    store.save_results(spark, path, dict(zip(names, G.multiplex_tables(nodes, edges), strict=True)))
    _, intra, _ = store.load_multiplex(spark, path)
    return intra.select("source_issuer", "target_issuer", "term", r6("weight").alias("weight"))


SIZES = """sz AS (SELECT l.layer, l.n AS n_nodes,
    (SELECT count(*) FROM ed WHERE ed.layer = l.layer) AS n_edges
  FROM (SELECT layer, count(*) AS n FROM nd GROUP BY 1) l)"""
_DENS = "CASE WHEN n_nodes > 1 THEN 2.0 * n_edges / (n_nodes * (n_nodes - 1.0))"


@query(
    "h1_network_size",
    graph_sql(T, SIZES)
    + f"""SELECT layer, n_nodes, n_edges, {q6(_DENS + ' ELSE 0.0 END')} AS density,
            {q6(_DENS + ' END')} AS edge_density, {q6('2.0 * n_edges / n_nodes')} AS avg_degree
          FROM sz""",
)
def h1(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(H.size_summary(nodes, edges, KEYS), "density", "edge_density", "avg_degree")


REACH = """rc AS (SELECT layer, node AS source, node FROM nd
  UNION SELECT rc.layer, rc.source, bw.other FROM rc
    JOIN bw ON rc.layer = bw.layer AND rc.node = bw.node),
cp AS (SELECT layer, source AS node, min(node) AS component FROM rc GROUP BY 1, 2),
cs AS (SELECT layer, component, count(*) AS size FROM cp GROUP BY 1, 2),
gc AS (SELECT layer, component FROM (SELECT *, row_number() OVER (
    PARTITION BY layer ORDER BY size DESC, component) AS r FROM cs) WHERE r = 1),
gn AS (SELECT cp.layer, cp.node FROM cp JOIN gc USING (layer, component))"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "h2_components",
    recursive(graph_sql(T, BOTH, REACH)) + "SELECT layer, node, component FROM cp",
)
def h2(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return H.components(nodes, edges, KEYS)


@query(
    "h2_component_summary",
    recursive(graph_sql(T, BOTH, REACH))
    + """SELECT layer, count(*) AS n_components, max(size) AS largest_component_size,
         count(*) = 1 AS is_connected FROM cs GROUP BY 1""",
)
def h2_summary(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return H.component_summary(H.components(nodes, edges, KEYS), KEYS)


TRI = """tr AS (SELECT e.layer, e.src AS a, e.dst AS b, f.dst AS c
  FROM ed e JOIN ed f ON e.layer = f.layer AND e.dst = f.src
  JOIN ed g ON g.layer = e.layer AND g.src = e.src AND g.dst = f.dst),
tn AS (SELECT layer, node, count(*) AS t FROM (
    SELECT layer, a AS node FROM tr UNION ALL SELECT layer, b FROM tr
    UNION ALL SELECT layer, c FROM tr) GROUP BY 1, 2),
lc AS (SELECT dg.layer, dg.node, coalesce(t, 0) AS t,
         degree * (degree - 1) / 2.0 AS w FROM dg LEFT JOIN tn USING (layer, node)),
cl AS (SELECT layer, CAST(sum(t) / 3 AS BIGINT) AS n_triangles,
         avg(CASE WHEN w > 0 THEN t / w ELSE 0.0 END) AS avg_clustering,
         CASE WHEN sum(w) > 0 AND sum(t) > 0 THEN sum(t) / sum(w) END AS transitivity
       FROM lc GROUP BY 1)"""


@query(
    "h3_clustering",
    graph_sql(T, BOTH, TRI)
    + f"""SELECT layer, n_triangles, {q6('avg_clustering')} AS avg_clustering,
            {q6('transitivity')} AS transitivity FROM cl""",
)
def h3(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(H.clustering(nodes, edges, KEYS), "avg_clustering", "transitivity")


PATHS = """hp AS (SELECT layer, node AS source, node, 0 AS hops FROM gn
  UNION SELECT hp.layer, hp.source, bw.other, hp.hops + 1 FROM hp
    JOIN bw ON hp.layer = bw.layer AND hp.node = bw.node WHERE hp.hops < 30),
sp AS (SELECT layer, source, node, min(hops) AS hops FROM hp GROUP BY 1, 2, 3),
ec AS (SELECT layer, source, max(hops) AS ecc, min(hops) AS low, sum(hops) AS total,
         count(*) AS n FROM sp WHERE hops > 0 GROUP BY 1, 2),
pt AS (SELECT layer, sum(total) / CAST(sum(n) AS DOUBLE) AS avg_shortest_path_length,
         CAST(max(ecc) AS DOUBLE) AS diameter, CAST(min(ecc) AS DOUBLE) AS radius,
         avg(ecc) AS avg_eccentricity, CAST(min(low) AS DOUBLE) AS shortest_path_length
       FROM ec GROUP BY 1)"""
_PATH_COLUMNS = f"""{q6('avg_shortest_path_length')} AS avg_shortest_path_length, diameter,
  radius, {q6('avg_eccentricity')} AS avg_eccentricity, shortest_path_length"""


@query(
    "h4_giant_paths",
    recursive(graph_sql(T, BOTH, REACH, PATHS)) + f"SELECT layer, {_PATH_COLUMNS} FROM pt",
)
def h4(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(
        H.path_summary(nodes, edges, KEYS), "avg_shortest_path_length", "avg_eccentricity"
    )


CENT = """dc AS (SELECT layer, node, CASE WHEN n > 1 THEN degree / (n - 1.0) ELSE 0.0 END AS value
  FROM dg JOIN (SELECT layer, count(*) AS n FROM nd GROUP BY 1) USING (layer))"""


@query(
    "h5_degree_centrality",
    graph_sql(T, BOTH, CENT) + f"SELECT layer, node, {q6('value')} AS value FROM dc",
)
def h5(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(H.degree_centrality(nodes, edges, KEYS), "value")


@query(
    "h6_eigenvector_centrality",
    recursive(graph_sql(T, BOTH, S.EIGENVECTOR)) + f"SELECT layer, node, {q6('value')} AS value FROM ev",
)
def h6(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(H.eigenvector_centrality(nodes, edges, KEYS), "value")


@query(
    "h7_betweenness",
    recursive(graph_sql(T, BOTH, S.DISTANCES, S.BETWEENNESS)) + f"SELECT layer, node, {q6('value')} AS value FROM bt",
)
def h7(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(H.betweenness(nodes, edges, KEYS), "value")


MIX = """en AS (SELECT bw.layer, bw.node, u.degree AS du, v.degree AS dv FROM bw
    JOIN dg u ON u.layer = bw.layer AND u.node = bw.node
    JOIN dg v ON v.layer = bw.layer AND v.node = bw.other),
as_ AS (SELECT layer, CASE WHEN stddev_pop(du) > 0 THEN corr(du, dv) END AS r FROM en GROUP BY 1),
an AS (SELECT dg.layer, avg(coalesce(a, 0)) AS k FROM dg LEFT JOIN (
    SELECT layer, node, avg(dv) AS a FROM en GROUP BY 1, 2) x USING (layer, node) GROUP BY 1)"""


@query(
    "h8_degree_mixing",
    graph_sql(T, BOTH, MIX)
    + f"""SELECT layer, {q6('k')} AS avg_neighbor_degree, {q6('r')} AS degree_assortativity
          FROM an LEFT JOIN as_ USING (layer)""",
)
def h8(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(
        H.degree_mixing(nodes, edges, KEYS), "avg_neighbor_degree", "degree_assortativity"
    )


@query(
    "h9_maximal_cliques",
    recursive(graph_sql(T, BOTH, S.CLIQUES)) + "SELECT layer, count(*) AS n_cliques FROM cl WHERE len(next) = 0 GROUP BY 1",
)
def h9(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return H.maximal_cliques(nodes, edges, KEYS)


@query(
    "h10_spectral_radius",
    recursive(graph_sql(T, BOTH, S.RADIUS))
    + f"""SELECT nn.layer, {q6('coalesce(radius, 0.0)')} AS spectral_radius
          FROM (SELECT DISTINCT layer FROM nd) nn LEFT JOIN sr USING (layer)""",
)
def h10(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(H.spectral_radius(nodes, edges, KEYS), "spectral_radius")


@query(
    "h11_modularity",
    graph_sql(
        T, BOTH,
        """mb AS (SELECT layer, node, length(node) AS community FROM nd),
           tg AS (SELECT e.layer, a.community AS ca, b.community AS cb, weight AS w FROM ed e
             JOIN mb a ON a.layer = e.layer AND a.node = e.src
             JOIN mb b ON b.layer = e.layer AND b.node = e.dst),
           pc AS (SELECT layer, c, sum(w) AS dg, sum(i) AS inn FROM (
             SELECT layer, ca AS c, w, CASE WHEN ca = cb THEN w ELSE 0 END AS i FROM tg
             UNION ALL SELECT layer, cb, w, 0 FROM tg) GROUP BY 1, 2)""",
    )
    + f"""SELECT layer, {q6('2 * sum(inn) / sum(dg) - sum(dg * dg) / (sum(dg) * sum(dg))')}
            AS modularity FROM pc GROUP BY 1""",
)
def h11(spark, d):
    """Partition by length of the node's name, to have one both engines know."""
    nodes, edges, _ = net_graph(spark, d)
    members = nodes.withColumn("community", F.length("node"))
    return rounded(H.modularity(edges, members, KEYS), "modularity")


@query("h12_greedy_communities")
def h12(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return H.greedy_communities(nodes, edges, KEYS)


@query(
    "h13_network_summary",
    recursive(graph_sql(T, BOTH, SIZES, REACH, TRI, PATHS))
    + f"""SELECT layer, n_nodes, n_edges, {q6(_DENS + ' ELSE 0.0 END')} AS density,
            {q6(_DENS + ' END')} AS edge_density, {q6('2.0 * n_edges / n_nodes')} AS avg_degree,
            n_components, largest_component_size, is_connected, n_triangles,
            {q6('avg_clustering')} AS avg_clustering, {q6('transitivity')} AS transitivity,
            {_PATH_COLUMNS}
          FROM sz JOIN (SELECT layer, count(*) AS n_components,
              max(size) AS largest_component_size, count(*) = 1 AS is_connected
            FROM cs GROUP BY 1) USING (layer)
          JOIN cl USING (layer) LEFT JOIN pt USING (layer)""",
)
def h13(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(
        H.network_summary(nodes, edges, KEYS),
        "density", "edge_density", "avg_degree", "avg_clustering", "transitivity",
        "avg_shortest_path_length", "avg_eccentricity",
    )


@query(
    "h14_layer_centrality",
    graph_sql(T, BOTH, CENT) + f"SELECT node, layer, {q6('value')} AS value FROM dc",
)
def h14(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    table = H.node_centrality(nodes, edges, KEYS, "degree")
    return table.select("node", "layer", r6("value").alias("value"))


@query(
    "h14_layer_eigenvector",
    recursive(graph_sql(T, BOTH, S.EIGENVECTOR)) + f"SELECT node, layer, {q6('value')} AS value FROM ev",
)
def h14_eigenvector(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    table = H.node_centrality(nodes, edges, KEYS, "eigenvector")
    return table.select("node", "layer", r6("value").alias("value"))


@query(
    "h14_layer_betweenness",
    recursive(graph_sql(T, BOTH, S.DISTANCES, S.BETWEENNESS)) + f"SELECT node, layer, {q6('value')} AS value FROM bt",
)
def h14_betweenness(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    table = H.node_centrality(nodes, edges, KEYS, "betweenness")
    return table.select("node", "layer", r6("value").alias("value"))


@query(
    "h15_node_metric_rows",
    graph_sql(T, BOTH, CENT)
    + f"""SELECT layer, node, 'weighted_degree' AS metric, {q6('weighted_degree')} AS value FROM dg
          UNION ALL SELECT layer, node, 'degree', {q6('value')} FROM dc""",
)
def h15(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(H.node_metric_rows(nodes, edges, KEYS, "degree"), "value")


# -- one network, without layers ------------------------------------------------

ALONE = Roles(())

#: The panel averaged over layers; the checks give it one constant layer.
ONE_NET = NET.replace("net AS", "net0 AS", 1) + """,
net AS (SELECT 'one' AS layer, dt, node, round(avg(value), 6) AS value FROM net0 GROUP BY dt, node)"""


def single_sql(*more: str) -> str:
    return graph_sql(T, *more).replace(NET, ONE_NET, 1)


def single_panel(spark, d):
    net = A.net_long(spark, d).groupBy("dt", "node").agg(F.round(F.avg("value"), 6).alias("value"))
    return cut_lineage(P.daily_returns(net, ALONE))


def single_graph(spark, d):
    panel = single_panel(spark, d)
    pairs = measure_pairs(panel, "pearson_correlation", ALONE, stored=True)
    return G.graph_nodes(panel, ALONE), cut_lineage(G.threshold_edges(pairs, T, ()))


@query(
    "single_network_pairs",
    RET_PAIRS.replace(NET, ONE_NET, 1)
    + f"""SELECT node_i, node_j, count(*) AS n_obs, {q6(CORR)} AS measure FROM pr GROUP BY 1, 2""",
)
def single_pairs(spark, d):
    pairs = measure_pairs(single_panel(spark, d), "pearson_correlation", ALONE, stored=True)
    return rounded(pairs, "measure")


@query(
    "single_network_degree",
    single_sql(BOTH) + f"SELECT node, degree, {q6('weighted_degree')} AS weighted_degree FROM dg",
)
def single_degree(spark, d):
    return rounded(G.degrees(*single_graph(spark, d), ()), "weighted_degree")


@query(
    "single_network_summary",
    recursive(single_sql(BOTH, SIZES, REACH, TRI, PATHS))
    + f"""SELECT n_nodes, n_edges, {q6(_DENS + ' ELSE 0.0 END')} AS density,
            {q6(_DENS + ' END')} AS edge_density, {q6('2.0 * n_edges / n_nodes')} AS avg_degree,
            n_components, largest_component_size, is_connected, n_triangles,
            {q6('avg_clustering')} AS avg_clustering, {q6('transitivity')} AS transitivity,
            {_PATH_COLUMNS}
          FROM sz JOIN (SELECT layer, count(*) AS n_components,
              max(size) AS largest_component_size, count(*) = 1 AS is_connected
            FROM cs GROUP BY 1) USING (layer)
          JOIN cl USING (layer) LEFT JOIN pt USING (layer)""",
)
def single_summary(spark, d):
    return rounded(
        H.network_summary(*single_graph(spark, d), ()),
        "density", "edge_density", "avg_degree", "avg_clustering", "transitivity",
        "avg_shortest_path_length", "avg_eccentricity",
    )
