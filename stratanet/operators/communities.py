"""Communities: spectral embedding, k-means, choice of k, alignment across layers.

A graph that fits a task is embedded and clustered there; a larger one is node
rows throughout (``spectral``). Choosing k per method and everything that
combines graphs is DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratanet.functions.maturity import term_order
from stratanet.operators import metrics as H
from stratanet.operators import spectral
from stratanet.operators.graph import multiplex_edges
from stratanet.session import cut_lineage
from stratanet.sources.tables import QueryError

# Methods of choosing k, and defaults of the search.
METHODS = ("FIXED", "SILHOUETTE", "MODULARITY", "DAVIES_BOULDIN", "CALINSKI_HARABASZ")
SCORES = ("silhouette", "modularity", "davies_bouldin", "calinski_harabasz")
MAX_CLUSTERS = 10
MIN_NODES = 3
MIN_JACCARD = 0.6
RESTARTS = 10
WINDOW_COMPONENTS = 8

Keys = tuple[str, ...]


# -- per-graph numerics ------------------------------------------------------------


def embed(A: np.ndarray, d: int) -> np.ndarray:
    """Leading |eigenvalue| directions of the degree-augmented adjacency."""
    n = len(A)
    B = A + np.diag(A.sum(axis=1) / max(n - 1, 1))
    values, vectors = np.linalg.eigh(B)
    top = np.argsort(-np.abs(values), kind="stable")[: min(d, n)]
    return vectors[:, top] * np.sqrt(np.abs(values[top]))


def kmeans(X: np.ndarray, k: int, restarts: int = RESTARTS):
    """Best of several seeded Lloyd runs: (labels, inertia)."""
    rng = np.random.default_rng(0)
    best = (np.inf, np.zeros(len(X), dtype=int))
    for _ in range(restarts):
        centres = X[[rng.integers(len(X))]]
        while len(centres) < k:
            gap = ((X[:, None] - centres) ** 2).sum(axis=2).min(axis=1)
            total = gap.sum()
            pick = rng.choice(len(X), p=gap / total) if total > 0 else rng.integers(len(X))
            centres = np.vstack([centres, X[pick]])
        labels = None
        for _ in range(300):
            dist = ((X[:, None] - centres) ** 2).sum(axis=2)
            now = dist.argmin(axis=1)
            if labels is not None and (now == labels).all():
                break
            labels = now
            for c in range(k):
                if (labels == c).any():
                    centres[c] = X[labels == c].mean(axis=0)
        inertia = float(((X - centres[labels]) ** 2).sum())
        if inertia < best[0] - 1e-12:
            best = (inertia, labels)
    return best[1], best[0]


def cluster_scores(A: np.ndarray, X: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    names, label = np.unique(labels, return_inverse=True)
    k, n = len(names), len(X)
    out = dict.fromkeys(SCORES, np.nan)
    two_m = A.sum()
    Z = np.eye(k)[label]
    if two_m > 0 and k >= 2:
        deg = Z.T @ A.sum(axis=1)
        out["modularity"] = float(np.trace(Z.T @ A @ Z) / two_m - (deg**2).sum() / two_m**2)
    if not 2 <= k < n:
        return out
    size = Z.sum(axis=0)
    centres = (Z.T @ X) / size[:, None]
    D = np.sqrt(np.maximum(((X[:, None] - X[None]) ** 2).sum(axis=2), 0.0))
    to = (D @ Z)
    own = to[np.arange(n), label] / np.maximum(size[label] - 1, 1)
    mean_to = to / size
    mean_to[np.arange(n), label] = np.inf
    other = mean_to.min(axis=1)
    with np.errstate(all="ignore"):
        s = np.where(size[label] > 1, (other - own) / np.maximum(own, other), 0.0)
    out["silhouette"] = float(np.nan_to_num(s).mean())
    within = ((X - centres[label]) ** 2).sum()
    between = (size * ((centres - X.mean(axis=0)) ** 2).sum(axis=1)).sum()
    out["calinski_harabasz"] = 1.0 if within == 0 else float(between * (n - k) / (within * (k - 1)))
    spread = np.array([np.sqrt(((X[label == c] - centres[c]) ** 2).sum(axis=1)).mean() for c in range(k)])
    gap = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    if np.allclose(spread, 0) or np.allclose(gap, 0):
        out["davies_bouldin"] = 0.0
    else:
        gap[gap == 0] = np.inf
        out["davies_bouldin"] = float(
            np.max((spread[:, None] + spread[None]) / gap - np.diag([np.inf] * k), axis=1).mean()
        )
    return out


# -- detection -----------------------------------------------------------------------


TRIED = {
    "k": T.IntegerType(), "is_fixed": T.BooleanType(), "searched": T.BooleanType(),
    "n_found": T.IntegerType(), "inertia": T.DoubleType(), **{s: T.DoubleType() for s in SCORES},
}


def numbers_of_clusters(n: int, max_clusters: int, exact_k: bool) -> tuple[list[int], int, int]:
    """(all k to try, the fixed one, the largest one searched) of a graph with n nodes."""
    cap = max(2, min(max_clusters, n - 1))
    fixed = max(2, min(max_clusters, n)) if exact_k else cap
    return sorted({*range(2, min(cap, n - 1) + 1), fixed}), fixed, min(cap, n - 1)


def clusterings(
    nodes: DataFrame, edges: DataFrame, keys: Keys, max_clusters: int = MAX_CLUSTERS,
    components: int | None = None, min_nodes: int = MIN_NODES, exact_k: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One row per k tried: (keys, k, is_fixed, searched, n_found, inertia, scores); and (keys, k, node, community).

    ``exact_k`` clips the fixed k to the number of nodes instead of one less.
    """
    on = list(keys)
    big = (
        nodes.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_nodes)
    )
    nodes = nodes.join(big, on, "left_semi")
    edges = edges.join(big, on, "left_semi")
    (nodes, edges), large = H.split_by_size(nodes, edges, keys)

    def run(names, i, j, weight, strength):
        del weight, strength
        n = len(names)
        A = np.zeros((n, n))
        A[i, j] = A[j, i] = 1.0
        X = embed(A, components or max(2, int(np.sqrt(n))))
        ks, fixed, searched = numbers_of_clusters(n, max_clusters, exact_k)
        rows = []
        for k in ks:
            labels, inertia = kmeans(X, k)
            score = cluster_scores(A, X, labels)
            rows.append(
                {
                    "k": k, "is_fixed": k == fixed, "searched": k <= searched,
                    "n_found": len(np.unique(labels)), "inertia": inertia,
                    **score, "nodes": list(names), "labels": labels.tolist(),
                }
            )
        return pd.DataFrame(rows)

    kind = nodes.schema["node"].dataType
    columns = {**TRIED, "nodes": T.ArrayType(kind), "labels": T.ArrayType(T.IntegerType())}
    found = cut_lineage(H.graph_kernel(nodes, edges, keys, run, columns))
    pair = found.select(*on, "k", F.explode(F.arrays_zip("nodes", "labels")).alias("p"))
    labels = pair.select(*on, "k", F.col("p.nodes").alias("node"), F.col("p.labels").alias("community"))
    tried = found.drop("nodes", "labels")
    if large:
        for more, of in large_clusterings(*large, keys, max_clusters, components, exact_k):
            tried, labels = tried.unionByName(more), labels.unionByName(of)
    return tried, labels


def large_clusterings(nodes: DataFrame, edges: DataFrame, keys: Keys, max_clusters: int, components: int | None, exact_k: bool):
    """Both tables of ``clusterings`` for each lot of graphs that are too large for a task.

    One row a graph is collected, each of which has more than ``TASK_NODES``
    nodes or ``TASK_EDGES`` edges.
    """
    spark, on = nodes.sparkSession, list(keys)
    graphs = nodes.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).orderBy(*on).collect()
    number = T.StructType([nodes.schema[k] for k in on] + [T.StructField("g", T.IntegerType())])
    numbers = spark.createDataFrame([(*r[:-1], g) for g, r in enumerate(graphs)], number)
    tries = {g: numbers_of_clusters(r["_n"], max_clusters, exact_k) for g, r in enumerate(graphs)}
    schema = T.StructType([T.StructField("g", T.IntegerType())] + [T.StructField(c, t) for c, t in TRIED.items()])
    runs = spectral.communities(
        nodes.join(numbers, on).select("g", "node"), edges.join(numbers, on).select("g", "src", "dst"),
        {g: r["_n"] for g, r in enumerate(graphs)}, {g: ks for g, (ks, _, _) in tries.items()}, components, RESTARTS,
    )
    for rows, labels in runs:
        table = [
            (g, k, k == tries[g][1], k <= tries[g][2], found, inertia, *(score[s] for s in SCORES))
            for g, k, found, inertia, score in rows
        ]
        tried = spark.createDataFrame(table, schema).join(numbers, "g").select(*on, *TRIED)
        yield tried, labels.join(F.broadcast(numbers), "g").select(*on, "k", "node", "community")


def choose(tried: DataFrame, keys: Keys, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(keys, method, k, n_clusters, score, inertia), best k per method.

    Ties keep the smaller k; without any valid score k is 2.
    """
    on = list(keys)

    def real(c: str) -> Column:
        return F.nanvl(c, F.lit(None))

    merit = {
        "FIXED": F.when(F.col("is_fixed"), F.lit(0.0)),
        "SILHOUETTE": real("silhouette"),
        "MODULARITY": real("modularity"),
        "DAVIES_BOULDIN": -real("davies_bouldin"),
        "CALINSKI_HARABASZ": real("calinski_harabasz"),
    }
    shown = {
        "FIXED": F.coalesce(real("silhouette"), F.lit(-1.0)),
        "SILHOUETTE": real("silhouette"),
        "MODULARITY": real("modularity"),
        "DAVIES_BOULDIN": real("davies_bouldin"),
        "CALINSKI_HARABASZ": real("calinski_harabasz"),
    }
    options = [
        F.struct(
            F.lit(m).alias("method"),
            (F.col("is_fixed") if m == "FIXED" else F.col("searched")).alias("ok"),
            (F.lit(0.0) if m == "FIXED" else F.when(F.col("n_found") >= 2, merit[m])).alias("merit"),
            shown[m].alias("score"),
        )
        for m in methods
    ]
    rows = tried.withColumn("o", F.explode(F.array(*options))).where("o.ok")
    rank = F.struct(F.coalesce("o.merit", F.lit(-1e308)), -F.col("k"))
    pick = F.struct("k", "n_found", "o.score", "inertia")
    best = rows.groupBy(*on, "o.method").agg(F.max_by(pick, rank).alias("b"))
    # The number that modularity finds is clustered anew; it was tried on the way.
    again = F.when((F.col("method") == "MODULARITY") & (F.col("b.n_found") >= 2), F.col("b.n_found")).otherwise(F.col("b.k"))
    counted = F.when(F.col("method") == "FIXED", F.col("b.n_found")).otherwise(again)
    return best.select(
        *on, "method", again.alias("k"), counted.alias("n_clusters"),
        F.col("b.score").alias("score"), F.col("b.inertia").alias("inertia"),
    )


def members(chosen: DataFrame, labels: DataFrame, keys: Keys) -> DataFrame:
    """(keys, method, node, community): the labels of the chosen k."""
    return chosen.select(*keys, "method", "k").join(labels, [*keys, "k"]).select(*keys, "method", "node", "community")


def layer_communities(
    nodes: DataFrame, edges: DataFrame, keys: Keys = ("layer",),
    methods: tuple[str, ...] = METHODS, max_clusters: int = MAX_CLUSTERS,
) -> tuple[DataFrame, DataFrame]:
    """(members, diagnostics) of every layer on its own; small layers have no rows."""
    tried, labels = clusterings(nodes, edges, keys, max_clusters)
    best = choose(tried, keys, methods)
    return members(best, labels, keys), best.select(*keys, "method", "n_clusters", "score")


def multiplex_communities(
    nodes: DataFrame, intra: DataFrame, inter: DataFrame, keys: Keys = (),
    methods: tuple[str, ...] = METHODS, max_clusters: int = MAX_CLUSTERS,
    components: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Communities of (issuer, term) vertices; (members, diagnostics with inertia)."""
    on = keys or ("run",)

    def vertex(c: str) -> Column:
        return F.concat_ws("␟", F.col(f"{c}.node").cast("string"), F.col(f"{c}.layer"))

    flat = multiplex_edges(intra, inter, keys)
    tag = [F.col(k) for k in keys] or [F.lit(1).alias("run")]
    e = flat.select(
        *tag, F.least(vertex("u"), vertex("v")).alias("src"),
        F.greatest(vertex("u"), vertex("v")).alias("dst"), "weight",
        F.col("weight").alias("strength"),
    )
    name = F.concat_ws("␟", F.col("issuer").cast("string"), F.col("term"))
    n = nodes.select(*tag, name.alias("node"))
    tried, labels = clusterings(n, e, on, max_clusters, components, exact_k=True)
    best = choose(tried, on, methods)
    parts = F.split("node", "␟")
    found = members(best, labels, on).select(
        *keys, "method", parts[0].alias("node"), parts[1].alias("layer"), "community"
    )
    return found, best.select(*keys, "method", "n_clusters", "score", "inertia")


# -- alignment -----------------------------------------------------------------------


def jaccard_table(found: DataFrame, layer: str = "layer", by: Keys = ("method",)) -> DataFrame:
    """(by, layer_a, community_a, layer_b, community_b, jaccard) of overlapping groups.

    Nodes are first folded into signatures (which community in which layer), so
    the pairing sees distinct signatures with counts, not nodes.
    """
    folded = signatures(found, layer, by)
    size = (
        folded.select(*by, "n", F.explode("sig").alias("s"))
        .groupBy(*by, "s.layer", "s.community")
        .agg(F.sum("n").alias("size"))
    )
    starts = F.explode(
        F.transform("sig", lambda a, i: F.struct(a.alias("a"), F.slice("sig", i + 2, F.size("sig")).alias("rest")))
    )
    both = (
        folded.select(*by, "n", starts.alias("p"))
        .select(*by, "n", "p.a", F.explode("p.rest").alias("b"))
        .groupBy(*by, F.col("a.layer").alias("layer_a"), F.col("a.community").alias("community_a"),
                 F.col("b.layer").alias("layer_b"), F.col("b.community").alias("community_b"))
        .agg(F.sum("n").alias("both"))
    )
    left = size.withColumnsRenamed({"layer": "layer_a", "community": "community_a", "size": "_sa"})
    right = size.withColumnsRenamed({"layer": "layer_b", "community": "community_b", "size": "_sb"})
    return (
        both.join(left, [*by, "layer_a", "community_a"])
        .join(right, [*by, "layer_b", "community_b"])
        .withColumn("jaccard", F.col("both") / (F.col("_sa") + F.col("_sb") - F.col("both")))
        .drop("_sa", "_sb", "both")
    )


def signatures(found: DataFrame, layer: str = "layer", by: Keys = ("method",)) -> DataFrame:
    cell = F.struct(F.col(layer).alias("layer"), F.col("community"))
    return (
        found.groupBy(*by, "node")
        .agg(F.sort_array(F.collect_list(cell)).alias("sig"))
        .groupBy(*by, "sig")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost matching of rows to columns by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    C = cost.T if flip else cost
    n, m = C.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for row in range(1, n + 1):
        owner[0] = row
        col = 0
        best = np.full(m + 1, np.inf)
        via = np.zeros(m + 1, dtype=int)
        used = np.zeros(m + 1, dtype=bool)
        while True:
            used[col] = True
            free = np.flatnonzero(~used[1:]) + 1
            slack = C[owner[col] - 1, free - 1] - u[owner[col]] - v[free]
            better = slack < best[free]
            best[free[better]] = slack[better]
            via[free[better]] = col
            nxt = free[best[free].argmin()]
            step = best[nxt]
            u[owner[used]] += step
            v[used] -= step
            best[free] -= step
            col = nxt
            if owner[col] == 0:
                break
        while col:
            owner[col] = owner[via[col]]
            col = via[col]
    pairs = [(owner[c] - 1, c - 1) for c in range(1, m + 1) if owner[c]]
    return [(b, a) for a, b in pairs] if flip else pairs


def _align_run(rows: pd.DataFrame, order: list[str], min_jaccard: float, max_ids: int | None):
    """Sequential matching of each layer's groups to founding groups.

    A group is the set of signature rows it appears in, weighted by node count.
    """
    n = rows["n"].to_numpy()
    groups: dict[str, dict[int, np.ndarray]] = {}
    for r, sig in enumerate(rows["sig"]):
        for s in sig:
            mask = groups.setdefault(s["layer"], {}).setdefault(
                s["community"], np.zeros(len(n), dtype=bool)
            )
            mask[r] = True

    def jaccard(a, b):
        union = n[a | b].sum()
        return n[a & b].sum() / union if union else 0.0

    canon: dict[int, np.ndarray] = {}
    next_id = 0
    out = []
    for layer in order:
        own = groups.get(layer, {})
        chosen: dict[int, int] = {}
        olds = sorted(own)
        if canon and olds:
            ids = sorted(canon)
            cost = np.array([[1.0 - jaccard(own[o], canon[c]) for c in ids] for o in olds])
            for r, c in assign(cost):
                if 1.0 - cost[r, c] >= min_jaccard:
                    chosen[olds[r]] = ids[c]
            nearest = {o: ids[int(cost[r].argmin())] for r, o in enumerate(olds)}
        else:
            nearest = {}
        founding = not canon
        left = sorted((o for o in olds if o not in chosen), key=lambda o: (-n[own[o]].sum(), o))
        overflow = []
        for o in left:
            if max_ids is None or len(canon) < max_ids:
                new = o if founding else next_id
                canon[new] = own[o].copy()
                next_id = max(next_id, new + 1)
                chosen[o] = new
            else:
                overflow.append(o)
        for o in overflow:
            home = nearest.get(o)
            if home is None:
                home = max(canon, key=lambda c, o=o: jaccard(own[o], canon[c]))
            canon[home] = canon[home] | own[o]
            chosen[o] = home
        out += [(layer, o, chosen[o]) for o in olds]
    return out


def align_labels(
    found: DataFrame, layer: str = "layer", by: Keys = ("method",),
    min_jaccard: float = MIN_JACCARD, max_ids: int | None = None, order: list[str] | None = None,
) -> DataFrame:
    """Same label for overlapping groups of different layers: found with ``aligned``.

    The order-dependent matching runs on the signature table of a run, whose
    length is the number of distinct community combinations.
    """
    if order is None:
        labels = found.select(F.col(layer).alias("t")).distinct().orderBy(*term_order(F.col("t")))
        order = [r[0] for r in labels.collect()]
    folded = signatures(found, layer, by)
    schema = T.StructType(
        [found.schema[k] for k in by]
        + [
            T.StructField(layer, T.StringType()), T.StructField("community", T.IntegerType()),
            T.StructField("aligned", T.IntegerType()),
        ]
    )

    def run(key, pdf):
        out = pd.DataFrame(
            _align_run(pdf.reset_index(drop=True), order, min_jaccard, max_ids),
            columns=[layer, "community", "aligned"],
        )
        for k, v in zip(by, key, strict=True):
            out[k] = v
        return out[[*by, layer, "community", "aligned"]]

    mapping = folded.groupBy(*by).applyInPandas(run, schema)
    return found.join(mapping, [*by, layer, "community"])


def community_matrix(
    nodes: DataFrame, edges: DataFrame, method: str = "SILHOUETTE",
    max_clusters: int = MAX_CLUSTERS, min_jaccard: float = MIN_JACCARD,
) -> DataFrame:
    """(node, layer, community) with labels comparable across layers."""
    found, _ = layer_communities(nodes, edges, ("layer",), (method,), max_clusters)
    aligned = align_labels(
        cut_lineage(found), min_jaccard=min_jaccard, max_ids=max_clusters
    )
    return aligned.select("node", "layer", F.col("aligned").alias("community"))


# -- windows -------------------------------------------------------------------------


def common_nodes(nodes: DataFrame, keys: Keys = ()) -> DataFrame:
    """Nodes present in every window of their key."""
    windows = nodes.select(*keys, "window_idx").distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_w")
    )
    seen = nodes.groupBy(*keys, "node").agg(F.count_distinct("window_idx").alias("_n"))
    both = seen.join(windows, list(keys)) if keys else seen.withColumn(
        "_w", windows.select("_w").scalar()
    )
    return both.where(F.col("_n") == F.col("_w")).select(*keys, "node")


def window_communities(
    nodes: DataFrame, edges: DataFrame, keys: Keys = (), methods: tuple[str, ...] = ("FIXED",),
    max_clusters: int = MAX_CLUSTERS, min_nodes: int = 2,
) -> tuple[DataFrame, DataFrame]:
    """Communities per window over the nodes common to all windows of a key."""
    common = cut_lineage(common_nodes(nodes, keys))
    windows = nodes.select("window_idx").distinct().count()
    if windows < 2:
        raise QueryError("windowed communities need at least two windows")
    if len(common.take(min_nodes)) < min_nodes:
        raise QueryError(f"fewer than {min_nodes} nodes are common to all windows")
    on = [*keys, "node"]
    kept = nodes.join(common, on, "left_semi")
    inside = edges
    for end in ("src", "dst"):
        inside = inside.join(common.withColumnRenamed("node", end), [*keys, end], "left_semi")
    graph = ("window_idx", *keys)
    tried, labels = clusterings(kept, inside, graph, max_clusters, min_nodes=min_nodes, exact_k=True)
    best = choose(tried, graph, methods)
    return members(best, labels, graph), best.select(*graph, "method", "n_clusters", "score")
