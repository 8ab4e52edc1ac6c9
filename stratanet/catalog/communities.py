"""C and W5: communities; labels are arbitrary, so checks compare overlaps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratanet.catalog.base import query, rounded
from stratanet.catalog.graphs import KEYS, T, graph_sql, net_graph
from stratanet.catalog.measures import ROLES, returns
from stratanet.catalog.sql import r6 as q6
from stratanet.catalog.windows import ROLLING
from stratanet.catalog.windows import T as WINDOW_T
from stratanet.operators import communities as K
from stratanet.operators import evolution as E
from stratanet.operators import graph as G
from stratanet.operators import spectral as S
from stratanet.session import cut_lineage
from stratanet.sources import adapters as A


@query("c1_c3_choice_of_k")
def c3(spark, d):
    """Every k tried on every layer, with its four scores."""
    nodes, edges, _ = net_graph(spark, d)
    tried, _ = K.clusterings(nodes, edges, KEYS)
    return rounded(tried, "inertia", *K.SCORES)


#: Customers of a region as points, their neighbours by key as edges, and two partitions that SQL can name.
_POINTS = """pt AS (SELECT n_regionkey AS g, c_custkey AS id, c_acctbal / 1000 AS x, c_nationkey * 1.0 AS y
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_LABELS = f"""{_POINTS},
lb AS (SELECT g, id, x, y, 3 AS k, id % 3 AS c FROM pt UNION ALL
  SELECT g, id, x, y, 5, CASE WHEN x < 2 THEN id % 2 WHEN x < 6 THEN 2 ELSE 4 END FROM pt)"""


def customer_points(spark, d):
    nation = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("int").alias("g"))
    x, y = F.col("c_acctbal").cast("double") / 1000.0, F.col("c_nationkey") * F.lit(1.0)
    return A.table(spark, d, "customer").join(nation, "c_nationkey").select(
        "g", F.col("c_custkey").cast("long").alias("id"), F.xxhash64("c_custkey").alias("hash"), F.array(x, y).alias("vec")
    )


_SCORES_SQL = f"""WITH {_LABELS},
sz AS (SELECT g, k, c, count(*) AS n, avg(x) AS mx, avg(y) AS my FROM lb GROUP BY 1, 2, 3),
al AS (SELECT g, k, count(*) AS n, count(DISTINCT c) AS kk, avg(x) AS ax, avg(y) AS ay FROM lb GROUP BY 1, 2),
ds AS (SELECT a.g, a.k, a.id, a.c, b.c AS o, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS s
  FROM lb a JOIN lb b ON a.g = b.g AND a.k = b.k GROUP BY 1, 2, 3, 4, 5),
po AS (SELECT ds.g, ds.k, id, sum(s / greatest(n - 1, 1)) FILTER (ds.c = o) AS own, min(s / n) FILTER (ds.c <> o) AS other,
  max(n) FILTER (ds.c = o) AS n FROM ds JOIN sz ON ds.g = sz.g AND ds.k = sz.k AND ds.o = sz.c GROUP BY 1, 2, 3),
si AS (SELECT g, k, avg(CASE WHEN n > 1 AND greatest(own, other) > 0 THEN (other - own) / greatest(own, other) ELSE 0 END) AS silhouette FROM po GROUP BY 1, 2),
sp AS (SELECT lb.g, lb.k, lb.c, any_value(sz.n) AS n, any_value(mx) AS mx, any_value(my) AS my,
  avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS apart, sum((x - mx) ** 2 + (y - my) ** 2) AS w
  FROM lb JOIN sz ON lb.g = sz.g AND lb.k = sz.k AND lb.c = sz.c GROUP BY 1, 2, 3),
db AS (SELECT g, k, avg(r) AS davies_bouldin FROM (SELECT a.g, a.k, a.c, max((a.apart + b.apart) / sqrt((a.mx - b.mx) ** 2 + (a.my - b.my) ** 2)) AS r
  FROM sp a JOIN sp b ON a.g = b.g AND a.k = b.k AND a.c <> b.c GROUP BY 1, 2, 3) GROUP BY 1, 2),
ch AS (SELECT sp.g, sp.k, any_value(kk) AS kk, sum(w) AS inertia, sum(sp.n * ((mx - ax) ** 2 + (my - ay) ** 2)) * (any_value(al.n) - any_value(kk)) / (sum(w) * (any_value(kk) - 1)) AS calinski_harabasz
  FROM sp JOIN al ON sp.g = al.g AND sp.k = al.k GROUP BY 1, 2),
ed AS (SELECT a.g, a.k, a.c AS ca, b.c AS cb FROM lb a JOIN lb b ON a.g = b.g AND a.k = b.k AND a.id <> b.id AND abs(a.id - b.id) <= 12),
dg AS (SELECT g, k, ca, count(*) AS n FROM ed GROUP BY 1, 2, 3),
tw AS (SELECT g, k, count(*) AS m2, count(*) FILTER (ca = cb) AS inner_ends FROM ed GROUP BY 1, 2),
mo AS (SELECT tw.g, tw.k, any_value(inner_ends) / any_value(m2) - sum(CAST(n AS DOUBLE) ** 2) / any_value(m2) ** 2 AS modularity
  FROM tw JOIN dg ON tw.g = dg.g AND tw.k = dg.k GROUP BY 1, 2)
SELECT CAST(ch.g AS INTEGER) AS g, CAST(ch.k AS INTEGER) AS k, CAST(kk AS INTEGER) AS n_found, {q6('inertia')} AS inertia, {q6('silhouette')} AS silhouette,
  {q6('modularity')} AS modularity, {q6('davies_bouldin')} AS davies_bouldin, {q6('calinski_harabasz')} AS calinski_harabasz
FROM ch JOIN si ON ch.g = si.g AND ch.k = si.k JOIN db ON ch.g = db.g AND ch.k = db.k JOIN mo ON ch.g = mo.g AND ch.k = mo.k"""


@query("c3_partition_scores", _SCORES_SQL)
def c3_scores(spark, d):
    """Four scores of two given partitions of the customers of each region, over node rows in tiles of 256."""
    x, three = F.col("vec")[0], F.col("id") % 3
    five = F.when(x < 2, F.col("id") % 2).when(x < 6, 2).otherwise(4)
    points = cut_lineage(customer_points(spark, d).withColumn("labels", F.array(three.cast("int"), five.cast("int"))))
    # Neighbours by key meet in a band of twelve keys or the one before it.
    band = F.floor(F.col("id") / 12)
    a = points.select("g", F.col("id").alias("src"), F.explode(F.sequence(band - 1, band + 1)).alias("band"))
    pairs = a.join(points.select("g", F.col("id").alias("dst"), band.alias("band")), ["g", "band"])
    pairs = cut_lineage(pairs.where("src != dst and abs(src - dst) <= 12").select("g", "src", "dst"))
    graphs = [r.g for r in points.select("g").distinct().collect()]
    rows = S.partition_scores(points, pairs, {g: [3, 5] for g in graphs}, block=256)
    table = [(g, k, found, inertia, *(score[c] for c in K.SCORES)) for g, k, found, inertia, score in rows]
    schema = "g int, k int, n_found int, inertia double, " + ", ".join(f"{c} double" for c in K.SCORES)
    return rounded(spark.createDataFrame(table, schema), "inertia", *K.SCORES)


def _lloyd_sql(rounds: int) -> str:
    steps = "".join(
        f""",
n{i + 1} AS (SELECT pt.g, x, y, arg_min(c.j, struct_pack(d := (x - cx) ** 2 + (y - cy) ** 2, j := c.j)) AS j FROM pt JOIN c{i} c ON pt.g = c.g GROUP BY pt.g, id, x, y),
m{i + 1} AS (SELECT g, j, count(*) AS size, avg(x) AS mx, avg(y) AS my FROM n{i + 1} GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.g, c.j, coalesce(mx, cx) AS cx, coalesce(my, cy) AS cy, coalesce(m.size, 0) AS size FROM c{i} c LEFT JOIN m{i + 1} m ON m.g = c.g AND m.j = c.j)"""
        for i in range(rounds)
    )
    return f"""WITH {_POINTS},
c0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY id) - 1 AS j, x AS cx, y AS cy, 0 AS size FROM pt QUALIFY j < 4){steps}
SELECT CAST(g AS INTEGER) AS g, CAST(j AS INTEGER) AS cluster, CAST(size AS BIGINT) AS size, {q6('cx')} AS x, {q6('cy')} AS y FROM c{rounds}"""


@query("c2_lloyd_rounds", _lloyd_sql(5))
def c2_lloyd(spark, d):
    """Five rounds of Lloyd over all customers of each region, from the four with the least keys."""
    points = cut_lineage(customer_points(spark, d))
    first = Window.partitionBy("g").orderBy("id")
    start = points.withColumn("j", F.row_number().over(first)).where("j <= 4").orderBy("g", "j").collect()
    sets = {g: [S.Clusters(4, np.array([r.vec for r in start if r.g == g]))] for g in {r.g for r in start}}
    S.followed(points, sets, rounds=5)
    table = [(g, j, int(c.size[j]), *map(float, c.centres[j])) for g, (c,) in sets.items() for j in range(4)]
    return rounded(spark.createDataFrame(table, "g int, cluster int, size long, x double, y double"), "x", "y")


@query("c4_layer_communities")
def c4(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return K.layer_communities(nodes, edges, methods=("SILHOUETTE",))[0]


@query("c5_multiplex_communities")
def c5(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    found, _ = K.multiplex_communities(*G.multiplex_tables(nodes, edges), methods=("MODULARITY",))
    return found


@query("c6_all_methods")
def c6(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return rounded(K.layer_communities(nodes, edges)[1], "score")


_PARTS = """mb AS (SELECT 'x' AS method, layer, node, length(node) % 2 + CASE WHEN layer = 'R'
  AND node LIKE '%1%' THEN 2 ELSE 0 END AS community FROM nd),
sz2 AS (SELECT method, layer, community, count(*) AS n FROM mb GROUP BY 1, 2, 3),
ov AS (SELECT a.method, a.layer AS layer_a, a.community AS community_a, b.layer AS layer_b,
  b.community AS community_b, count(*) AS n FROM mb a JOIN mb b
  ON a.node = b.node AND a.layer < b.layer GROUP BY 1, 2, 3, 4, 5)"""


@query(
    "c7_jaccard_overlap",
    graph_sql(T, _PARTS)
    + f"""SELECT ov.method, layer_a, community_a, layer_b, community_b,
            {q6('ov.n / CAST(a.n + b.n - ov.n AS DOUBLE)')} AS jaccard FROM ov
          JOIN sz2 a ON a.layer = layer_a AND a.community = community_a
          JOIN sz2 b ON b.layer = layer_b AND b.community = community_b""",
)
def c7(spark, d):
    """Overlap of a partition both engines can name."""
    nodes, _, _ = net_graph(spark, d)
    extra = F.when((F.col("layer") == "R") & F.col("node").like("%1%"), 2).otherwise(0)
    found = nodes.select(
        F.lit("x").alias("method"), "layer", "node",
        (F.length("node") % 2 + extra).alias("community"),
    )
    return rounded(K.jaccard_table(found), "jaccard")


@query("c7_aligned_labels")
def c7_align(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    found = cut_lineage(K.layer_communities(nodes, edges)[0])
    return K.align_labels(found, max_ids=K.MAX_CLUSTERS).drop("community")


@query("c8_community_matrix")
def c8(spark, d):
    nodes, edges, _ = net_graph(spark, d)
    return K.community_matrix(nodes, edges)


@query("c9_window_communities")
def c9(spark, d):
    nodes, edges = E.evolution_graphs(returns(spark, d), ROLLING, threshold=WINDOW_T, roles=ROLES)
    return K.window_communities(nodes, edges, KEYS, ("SILHOUETTE",))[0]


@query("w5_links_table")
def w5(spark, d):
    """Edge mix of every window with the number of communities per method."""
    mix, nodes, edges = E.multiplex_evolution(A.net_long(spark, d), ROLLING, threshold=WINDOW_T)
    key = ("window_idx",)
    tables = G.multiplex_tables(cut_lineage(nodes), edges, key)
    _, best = K.multiplex_communities(*tables, keys=key, components=K.WINDOW_COMPONENTS)
    table = E.links_table(mix, best, list(K.METHODS))
    return rounded(table, "pct_intra", "pct_inter")
