"""SQL of graph measures that take rounds: paths, power iteration and cliques."""

from __future__ import annotations

#: Least distances by doubling the number of edges; ``bw`` has both directions of every edge.
_DOUBLINGS = 5
DISTANCES = """ar AS MATERIALIZED (SELECT layer, node, other, greatest(weight, 1e-12) AS w FROM bw),
d0 AS MATERIALIZED (SELECT layer, node AS u, node AS v, 0.0::DOUBLE AS x FROM nd
  UNION ALL SELECT layer, node, other, w FROM ar)""" + "".join(
    f""",
d{k + 1} AS MATERIALIZED (SELECT a.layer, a.u, b.v, min(a.x + b.x) AS x FROM d{k} a JOIN d{k} b
  ON a.layer = b.layer AND a.v = b.u GROUP BY 1, 2, 3)"""
    for k in range(_DOUBLINGS)
) + f""",
di AS MATERIALIZED (SELECT * FROM d{_DOUBLINGS})"""

#: Numbers of shortest paths, wave by wave, and the share of them that a node lies on.
BETWEENNESS = """dag AS MATERIALIZED (SELECT s.layer, s.u AS s, ar.node AS p, ar.other AS q FROM di s
  JOIN ar ON ar.layer = s.layer AND ar.node = s.v
  JOIN di t ON t.layer = s.layer AND t.u = s.u AND t.v = ar.other
  WHERE abs(s.x + w - t.x) <= 1e-14 * t.x AND s.x < t.x),
wv AS (SELECT layer, node AS s, node AS v, 1.0::DOUBLE AS c, 0 AS hop FROM nd
  UNION ALL SELECT g.layer, g.s, g.q, sum(c), hop + 1 FROM wv JOIN dag g
    ON g.layer = wv.layer AND g.s = wv.s AND g.p = wv.v GROUP BY g.layer, g.s, g.q, hop),
sg AS MATERIALIZED (SELECT di.layer, di.u AS u, di.v AS v, any_value(x) AS x, sum(c) AS c FROM di
  JOIN wv ON wv.layer = di.layer AND wv.s = di.u AND wv.v = di.v GROUP BY 1, 2, 3),
be AS (SELECT st.layer, a.v AS node, sum(a.c * b.c / st.c) AS total FROM sg st
  JOIN sg a ON a.layer = st.layer AND a.u = st.u JOIN sg b ON b.layer = st.layer AND b.u = a.v AND b.v = st.v
  WHERE st.u <> st.v AND a.v <> st.u AND a.v <> st.v AND abs(a.x + b.x - st.x) <= 1e-14 * st.x GROUP BY 1, 2),
nn AS (SELECT layer, count(*) AS n FROM nd GROUP BY 1),
bt AS (SELECT nd.layer, nd.node, CASE WHEN n > 2 THEN coalesce(total, 0) / ((n - 1.0) * (n - 2.0)) ELSE 0.0 END AS value
  FROM nd JOIN nn USING (layer) LEFT JOIN be ON be.layer = nd.layer AND be.node = nd.node)"""

_ROWS = """nk AS (SELECT layer, node, row_number() OVER (PARTITION BY layer ORDER BY node) AS k,
  count(*) OVER (PARTITION BY layer) AS n FROM nd),
mr AS (SELECT a.layer, a.k, any_value(a.n) AS n, list(coalesce({weight}, 0.0)::DOUBLE + CASE WHEN a.k = b.k THEN 1.0 ELSE 0.0 END ORDER BY b.k) AS r
  FROM nk a JOIN nk b USING (layer) LEFT JOIN bw ON bw.layer = a.layer AND bw.node = a.node AND bw.other = b.node GROUP BY 1, 2),
mx AS MATERIALIZED (SELECT layer, any_value(n) AS n, list(r ORDER BY k) AS m FROM mr
  WHERE layer IN (SELECT layer FROM ed) GROUP BY 1)"""

#: x and (A + I) x in turn, until the entries move by less than a millionth each on average.
EIGENVECTOR = _ROWS.format(weight="strength") + """,
it AS (SELECT layer, n, m, list_transform(range(n), lambda i: 1.0::DOUBLE / n) AS x, false AS done, 0 AS turn FROM mx
  UNION ALL SELECT layer, n, m, z, list_sum(list_transform(range(1, n + 1), lambda i: abs(z[i] - x[i]))) < n * 1e-6, turn + 1
  FROM (SELECT *, list_transform(y, lambda v: v / sqrt(list_sum(list_transform(y, lambda t: t * t)))) AS z
    FROM (SELECT *, list_transform(m, lambda r: list_dot_product(r, x)) AS y FROM it WHERE NOT done AND turn < 1000))),
ev AS (SELECT nk.layer, node, coalesce(x[k], 0.0) AS value FROM nk LEFT JOIN (SELECT * FROM it WHERE done) f USING (layer))"""

#: The largest eigenvalue of a matrix without negative entries, by its quotient after many rounds.
RADIUS = _ROWS.format(weight="CASE WHEN bw.other IS NOT NULL THEN 1.0 END") + """,
it AS (SELECT layer, n, m, list_transform(range(n), lambda i: 1.0::DOUBLE) AS x, 0 AS turn FROM mx
  UNION ALL SELECT layer, n, m, list_transform(y, lambda v: v / list_max(y)), turn + 1
  FROM (SELECT *, list_transform(m, lambda r: list_dot_product(r, x)) AS y FROM it WHERE turn < 400)),
sr AS (SELECT layer, list_dot_product(x, list_transform(m, lambda r: list_dot_product(r, x))) / list_dot_product(x, x) - 1.0 AS radius
  FROM it WHERE turn = 400)"""

#: Every clique once, by ascending names; it is maximal if no node is next to all of it.
CLIQUES = """nb AS MATERIALIZED (SELECT nd.layer, nd.node, coalesce(list(bw.other) FILTER (bw.other IS NOT NULL), []) AS near
  FROM nd LEFT JOIN bw ON bw.layer = nd.layer AND bw.node = nd.node GROUP BY 1, 2),
cl AS (SELECT layer, node AS last, near AS next FROM nb
  UNION ALL SELECT cl.layer, nb.node, list_intersect(next, near) FROM cl JOIN nb
    ON nb.layer = cl.layer AND nb.node > cl.last AND list_contains(next, nb.node))"""
