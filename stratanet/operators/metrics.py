"""Graph metrics keyed by graph; every graph of a run is measured in one job.

Counting metrics are joins and aggregates.  Reachability metrics are fixpoint
loops whose state is checkpointed once per round.  Metrics that need a whole
adjacency matrix run per graph when the graph is small (its size is counted,
not assumed) and as a join-aggregate loop when it is not.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratanet.functions.moments import safe_corr
from stratanet.operators import spectral
from stratanet.operators.graph import both_ways, degrees
from stratanet.operators.keyless import keyless
from stratanet.session import cut_lineage, is_empty

#: A graph handed to one task has at most this many nodes and edges.
TASK_NODES = 2_000
TASK_EDGES = 1_000_000

#: Cells of one working array of a task.
WORK_CELLS = 8_000_000
#: Lengths of paths are equal if they differ by no more than this part; weights below the least count as it.
TIE = 1e-14
LEAST_WEIGHT = 1e-12

Keys = tuple[str, ...]


def split_by_size(nodes: DataFrame, edges: DataFrame, keys: Keys):
    """((nodes, edges) of graphs that fit a task, (nodes, edges) of the others).

    The second is None when every graph fits, which one count settles.
    """
    on = list(keys)
    n = nodes.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    m = edges.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    large = (
        n.where(F.col("_n") > TASK_NODES)
        .select(*on)
        .unionByName(m.where(F.col("_n") > TASK_EDGES).select(*on))
        .distinct()
    )
    if is_empty(large):
        return (nodes, edges), None
    return (
        (nodes.join(large, on, "left_anti"), edges.join(large, on, "left_anti")),
        (nodes.join(large, on, "left_semi"), edges.join(large, on, "left_semi")),
    )


def graph_kernel(
    nodes: DataFrame,
    edges: DataFrame,
    keys: Keys,
    fn: Callable[..., pd.DataFrame],
    columns: dict[str, T.DataType],
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Run ``fn(names, i, j, weight, strength)`` per graph of bounded size.

    i and j index the sorted node names.  ``extra`` are node columns handed to
    ``fn`` as a dict of arrays in node order.
    """
    values = [F.col(c).cast("double").alias(c) for c in ("weight", "strength")]
    blank = [F.lit(None).cast("double").alias(c) for c in ("weight", "strength")]
    node_type = nodes.schema["node"].dataType
    rows = nodes.select(
        *keys, F.col("node").alias("src"), F.lit(None).cast(node_type).alias("dst"), *blank, *extra
    ).unionByName(edges.select(*keys, "src", "dst", *values), allowMissingColumns=True)
    schema = T.StructType(
        [nodes.schema[k] for k in keys] + [T.StructField(c, t, True) for c, t in columns.items()]
    )

    def run(key, pdf):
        is_node = pdf["dst"].isna()
        own = pdf[is_node].sort_values("src")
        names = own["src"].to_numpy()
        at = {v: k for k, v in enumerate(names)}
        e = pdf[~is_node]
        i = e["src"].map(at).to_numpy(dtype=np.int64)
        j = e["dst"].map(at).to_numpy(dtype=np.int64)
        more = {c: own[c].to_numpy() for c in extra}
        out = fn(names, i, j, e["weight"].to_numpy(), e["strength"].to_numpy(), **more)
        for k, v in zip(keys, key, strict=True):
            out[k] = v
        return out[[*keys, *columns]]

    return rows.groupBy(*keys).applyInPandas(run, schema)


# -- counts --------------------------------------------------------------------


@keyless
def size_summary(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """n_nodes, n_edges, density (0 below two nodes), edge_density (null), avg_degree."""
    on = list(keys)
    n = nodes.groupBy(*on).agg(F.count(F.lit(1)).alias("n_nodes"))
    m = edges.groupBy(*on).agg(F.count(F.lit(1)).alias("n_edges"))
    both = n.join(m, on, "left").fillna(0, ["n_edges"])
    N, E = F.col("n_nodes").cast("double"), F.col("n_edges").cast("double")
    full = N * (N - 1.0)
    return (
        both.withColumn("density", F.when(full > 0, 2.0 * E / full).otherwise(0.0))
        .withColumn("edge_density", F.when(full > 0, 2.0 * E / full))
        .withColumn("avg_degree", 2.0 * E / N)
    )


@keyless
def degree_centrality(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """degree / (N - 1); 1 for a lone node of a graph with edges, 0 without."""
    on = list(keys)
    deg = degrees(nodes, edges, keys)
    n = nodes.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return deg.join(n, on).select(
        *on,
        "node",
        F.when(F.col("_n") > 1, F.col("degree") / (F.col("_n") - 1)).otherwise(0.0).alias("value"),
    )


# -- components ----------------------------------------------------------------


def _neighbours(n: int, i, j) -> list[list[int]]:
    near: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(i, j, strict=True):
        near[a].append(b)
        near[b].append(a)
    return near


def _hops_from(near: list[list[int]], start: int) -> dict[int, int]:
    seen, wave, hops = {start: 0}, [start], 0
    while wave:
        hops += 1
        wave = list({v for u in wave for v in near[u] if v not in seen})
        seen.update(dict.fromkeys(wave, hops))
    return seen


def _components_small(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    def run(names, i, j, weight, strength):
        del weight, strength
        near = _neighbours(len(names), i, j)
        label = np.full(len(names), -1)
        for v in range(len(names)):
            if label[v] < 0:
                label[list(_hops_from(near, v))] = v
        return pd.DataFrame({"node": names, "component": names[label]})

    kind = nodes.schema["node"].dataType
    return graph_kernel(nodes, edges, keys, run, {"node": kind, "component": kind})


@keyless
def components(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """(keys, node, component): the least node of the component."""
    small, large = split_by_size(nodes, edges, keys)
    result = _components_small(*small, keys)
    if large:
        result = result.unionByName(_components_large(*large, keys))
    return cut_lineage(result)


def _components_large(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """The same labels as joins.

    Each round takes the least neighbouring label and then the label of that
    label, so long paths close in logarithmically many rounds.
    """
    on = list(keys)
    adjacency = both_ways(edges).select(*on, "node", "other")
    labels = cut_lineage(
        nodes.select(*on, "node", F.col("node").alias("component"))
    )
    adjacency = cut_lineage(adjacency)
    while True:
        near = (
            adjacency.join(
                labels.select(*on, F.col("node").alias("other"), F.col("component").alias("_c")),
                [*on, "other"],
            )
            .groupBy(*on, "node")
            .agg(F.min("_c").alias("_near"))
        )
        lower = labels.join(near, [*on, "node"], "left").select(
            *on, "node", F.col("component").alias("_old"),
            F.least("component", F.coalesce("_near", "component")).alias("component"),
        )
        top = lower.select(*on, F.col("node").alias("component"), F.col("component").alias("_top"))
        labels = cut_lineage(
            lower.join(top, [*on, "component"]).select(
                *on, "node", "_old", F.least("component", "_top").alias("component")
            )
        )
        if is_empty(labels.where(F.col("component") != F.col("_old"))):
            return labels.drop("_old")


@keyless
def component_summary(labels: DataFrame, keys: Keys) -> DataFrame:
    """Number of components, the largest, and the label of that one."""
    on = list(keys)
    sizes = labels.groupBy(*on, "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(*on).agg(
        F.count(F.lit(1)).alias("n_components"),
        F.max("size").alias("largest_component_size"),
        (F.count(F.lit(1)) == 1).alias("is_connected"),
    )


@keyless
def giant_component(labels: DataFrame, keys: Keys) -> DataFrame:
    """(keys, node) of the largest component; the least label wins a tie."""
    on = list(keys)
    sizes = labels.groupBy(*on, "component").agg(F.count(F.lit(1)).alias("size"))
    giant = (
        sizes.groupBy(*on)
        .agg(F.max(F.struct("size")).alias("_top"))
        .join(sizes, on)
        .where(F.col("size") == F.col("_top.size"))
        .groupBy(*on)
        .agg(F.min("component").alias("component"))
    )
    return labels.join(giant, [*on, "component"], "left_semi").select(*on, "node")


# -- triangles -----------------------------------------------------------------


@keyless
def triangles(edges: DataFrame, keys: Keys) -> DataFrame:
    """(keys, a, b, c), each triangle once.

    Edges point from the lower to the higher degree, which bounds the wedges a
    hub can open by the square root of the number of edges.
    """
    on = list(keys)
    ends = both_ways(edges).groupBy(*on, "node").agg(F.count(F.lit(1)).alias("deg"))
    e = (
        edges.select(*on, "src", "dst")
        .join(ends.withColumnsRenamed({"node": "src", "deg": "_ds"}), [*on, "src"])
        .join(ends.withColumnsRenamed({"node": "dst", "deg": "_dd"}), [*on, "dst"])
    )
    src = F.struct(F.col("_ds").alias("deg"), F.col("src").alias("id"))
    dst = F.struct(F.col("_dd").alias("deg"), F.col("dst").alias("id"))
    arcs = e.select(
        *on, F.least(src, dst).alias("lo"), F.greatest(src, dst).alias("hi")
    ).select(*on, "lo", "hi")
    first = arcs.select(*on, "lo", F.col("hi").alias("b"))
    second = arcs.select(*on, "lo", F.col("hi").alias("c"))
    wedges = first.join(second, [*on, "lo"]).where(F.col("b") < F.col("c"))
    closing = arcs.select(*on, F.col("lo").alias("b"), F.col("hi").alias("c"))
    return wedges.join(closing, [*on, "b", "c"], "left_semi").select(
        *on, F.col("lo.id").alias("a"), F.col("b.id").alias("b"), F.col("c.id").alias("c")
    )


@keyless
def clustering(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """n_triangles, mean local clustering (zeros counted), transitivity (0 -> null)."""
    on = list(keys)
    tri = triangles(edges, keys)
    per_node = (
        tri.select(*on, F.explode(F.array("a", "b", "c")).alias("node"))
        .groupBy(*on, "node")
        .agg(F.count(F.lit(1)).alias("t"))
    )
    d = F.col("degree").cast("double")
    local = (
        degrees(nodes, edges, keys)
        .join(per_node, [*on, "node"], "left")
        .fillna(0, ["t"])
        .withColumn("wedges", d * (d - 1.0) / 2.0)
    )
    t = F.sum("t").cast("double")
    return local.groupBy(*on).agg(
        (F.sum("t") / 3).cast("bigint").alias("n_triangles"),
        F.avg(F.when(F.col("wedges") > 0, F.col("t") / F.col("wedges")).otherwise(0.0)).alias(
            "avg_clustering"
        ),
        F.when((F.sum("wedges") > 0) & (t > 0), t / F.sum("wedges")).alias("transitivity"),
    )


# -- paths ---------------------------------------------------------------------


@keyless
def hop_counts(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """(keys, source, node, hops) for every ordered pair that is connected.

    One frontier for all sources of all graphs; rounds are as many as the
    largest diameter.
    """
    on = list(keys)
    adjacency = cut_lineage(both_ways(edges).select(*on, "node", "other"))
    frontier = cut_lineage(
        nodes.select(*on, F.col("node").alias("source"), "node", F.lit(0).alias("hops"))
    )
    seen = frontier
    hops = 0
    while True:
        hops += 1
        reached = (
            frontier.select(*on, "source", "node")
            .join(adjacency, [*on, "node"])
            .select(*on, "source", F.col("other").alias("node"))
            .distinct()
            .join(seen.select(*on, "source", "node"), [*on, "source", "node"], "left_anti")
            .withColumn("hops", F.lit(hops))
        )
        frontier = cut_lineage(reached)
        if is_empty(frontier):
            return seen
        seen = seen.unionByName(frontier)


@keyless
def path_summary(
    nodes: DataFrame, edges: DataFrame, keys: Keys, labels: DataFrame | None = None
) -> DataFrame:
    """Hop statistics of the giant component; no row when it has one node."""
    on = list(keys)
    if labels is None:
        labels = components(nodes, edges, keys)
    giant = cut_lineage(giant_component(labels, keys))
    inside = edges.join(giant.withColumnRenamed("node", "src"), [*on, "src"], "left_semi")
    small, large = split_by_size(giant, inside, keys)
    per_source = _eccentricity_small(*small, keys)
    if large:
        per_source = per_source.unionByName(_eccentricity_large(*large, keys))
    return per_source.groupBy(*on).agg(
        (F.sum("total") / F.sum("n")).alias("avg_shortest_path_length"),
        F.max("ecc").cast("double").alias("diameter"),
        F.min("ecc").cast("double").alias("radius"),
        F.avg("ecc").alias("avg_eccentricity"),
        F.min("low").cast("double").alias("shortest_path_length"),
    )


_ECCENTRICITY = {c: T.LongType() for c in ("ecc", "low", "total", "n")}


def _sorted_arcs(n: int, i: np.ndarray, j: np.ndarray, w: np.ndarray):
    """Both directions of the edges by target: (source, target, weight, first arc of each target, those targets)."""
    u, v, w = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([w, w])
    by = np.argsort(v, kind="stable")
    u, v, w = u[by], v[by], w[by]
    targets, first = np.unique(v, return_index=True)
    return u, v, w, first, targets


def _source_batches(n: int, n_arcs: int):
    """Sources that are followed at once, so that a value for each arc and source fits WORK_CELLS."""
    step = max(1, WORK_CELLS // max(1, n_arcs + n))
    for lo in range(0, n, step):
        yield np.arange(lo, min(n, lo + step))


def _distances(n: int, arcs, sources: np.ndarray) -> np.ndarray:
    """(node, source) least sum of weights, infinite where there is no path; all sources are relaxed together."""
    u, _, w, first, targets = arcs
    D = np.full((n, len(sources)), np.inf)
    D[sources, np.arange(len(sources))] = 0.0
    while len(u):
        offer = np.minimum.reduceat(D[u] + w[:, None], first, axis=0)
        if not (offer < D[targets] * (1.0 - TIE)).any():
            break
        D[targets] = np.minimum(D[targets], offer)
    return D


def _eccentricity_small(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    def run(names, i, j, weight, strength):
        del weight, strength
        n, parts = len(names), []
        arcs = _sorted_arcs(n, i, j, np.ones(len(i)))
        for sources in _source_batches(n, len(arcs[0])):
            hops = _distances(n, arcs, sources)
            there = np.isfinite(hops) & (hops > 0)
            some = there.any(axis=0)
            table = {
                "source": names[sources],
                "ecc": np.where(there, hops, 0).max(axis=0), "low": np.where(there, hops, np.inf).min(axis=0),
                "total": np.where(there, hops, 0).sum(axis=0), "n": there.sum(axis=0),
            }
            part = pd.DataFrame(table)[some]
            parts.append(part.astype({c: "int64" for c in _ECCENTRICITY}))
        return pd.concat(parts)

    kind = nodes.schema["node"].dataType
    return graph_kernel(nodes, edges, keys, run, {"source": kind, **_ECCENTRICITY})


def _eccentricity_large(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    hops = hop_counts(nodes, edges, keys).where(F.col("hops") > 0)
    return hops.groupBy(*keys, "source").agg(
        F.max("hops").cast("bigint").alias("ecc"),
        F.min("hops").cast("bigint").alias("low"),
        F.sum("hops").alias("total"),
        F.count(F.lit(1)).alias("n"),
    )


def _waves(x: np.ndarray, step: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """x + step(x) + step(step(x)) + … until nothing is left."""
    total = x.copy()
    while True:
        x = step(x)
        if not x.any():
            return total
        total += x


def _betweenness_small(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Path counts run down the shortest-path arcs of a batch of sources, dependencies back up."""

    def run(names, i, j, weight, strength):
        del strength
        n = len(names)
        arcs = _sorted_arcs(n, i, j, np.maximum(weight, LEAST_WEIGHT))
        u, v, w, first, targets = arcs
        # The graph is undirected: an arc's reverse lets sums by source use the order by target.
        back = np.lexsort((v, u))
        sums = np.zeros(n)
        for sources in _source_batches(n, len(u)) if len(u) else ():
            D = _distances(n, arcs, sources)
            with np.errstate(invalid="ignore"):
                tight = (np.abs(D[u] + w[:, None] - D[v]) <= TIE * D[v]) & (D[u] < D[v])

            def down(x, tight=tight):
                out = np.zeros_like(x)
                out[targets] = np.add.reduceat(x[u] * tight, first, axis=0)
                return out

            start = np.zeros_like(D)
            start[sources, np.arange(len(sources))] = 1.0
            paths = _waves(start, down)
            share = np.divide(paths[u], paths[v], out=np.zeros(tight.shape), where=tight)

            def up(x, share=share):
                out = np.zeros_like(x)
                out[targets] = np.add.reduceat((x[v] * share)[back], first, axis=0)
                return out

            depends = _waves(up(np.ones_like(D)), up)
            depends[sources, np.arange(len(sources))] = 0.0
            sums += depends.sum(axis=1)
        pairs = (n - 1.0) * (n - 2.0)
        return pd.DataFrame({"node": names, "value": sums / pairs if pairs > 0 else 0.0 * sums})

    return graph_kernel(nodes, edges, keys, run, {"node": nodes.schema["node"].dataType, "value": T.DoubleType()})


@keyless
def betweenness(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Weighted shortest-path betweenness, normalised; paths whose lengths differ by rounding only are equal."""
    small, large = split_by_size(nodes, edges, keys)
    result = _betweenness_small(*small, keys)
    if large:
        result = result.unionByName(_betweenness_large(*large, keys))
    return result


def _betweenness_large(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """The same as three propagation loops.

    Distances settle by relaxation; then path counts run down the shortest-path
    arcs of every source, and dependencies run back up, one hop per round.
    """
    on = list(keys)
    at = [*on, "source", "node"]
    arcs = cut_lineage(
        both_ways(edges, "weight").select(
            *on, "node", "other", F.greatest("weight", F.lit(LEAST_WEIGHT)).alias("w")
        )
    )
    best = cut_lineage(
        nodes.select(*on, F.col("node").alias("source"), "node", F.lit(0.0).alias("dist"))
    )
    moved = best
    while True:
        offer = (
            moved.join(arcs, [*on, "node"])
            .select(*on, "source", F.col("other").alias("node"), (F.col("dist") + F.col("w")).alias("_d"))
            .groupBy(*at)
            .agg(F.min("_d").alias("_d"))
        )
        merged = cut_lineage(
            best.join(offer, at, "full").select(
                *at,
                F.least("dist", "_d").alias("dist"),
                (F.col("dist").isNull() | (F.col("_d") < F.col("dist") * (1.0 - TIE))).alias("_moved"),
            )
        )
        best = merged.select(*at, "dist")
        moved = merged.where("_moved").select(*at, "dist")
        if is_empty(moved):
            break
    tail = best.join(arcs, [*on, "node"]).select(
        *on, "source", F.col("node").alias("u"), F.col("other").alias("v"),
        (F.col("dist") + F.col("w")).alias("_reach"), F.col("dist").alias("_du"),
    )
    head = best.select(*on, "source", F.col("node").alias("v"), "dist")
    dag = cut_lineage(
        tail.join(head, [*on, "source", "v"])
        .where((F.abs(F.col("_reach") - F.col("dist")) <= TIE * F.col("dist")) & (F.col("_du") < F.col("dist")))
        .select(*on, "source", "u", "v")
    )

    def propagate(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
        parts, wave = [start], start
        while True:
            wave = cut_lineage(step(wave))
            if is_empty(wave):
                break
            parts.append(wave)
        total = parts[0]
        for p in parts[1:]:
            total = total.unionByName(p)
        return total.groupBy(*at).agg(F.sum("x").alias("x"))

    start = cut_lineage(
        nodes.select(*on, F.col("node").alias("source"), "node", F.lit(1.0).alias("x"))
    )
    counts = cut_lineage(
        propagate(
            start,
            lambda w: w.withColumnRenamed("node", "u")
            .join(dag, [*on, "source", "u"])
            .groupBy(*on, "source", F.col("v").alias("node"))
            .agg(F.sum("x").alias("x")),
        )
    )
    share = cut_lineage(
        dag.join(counts.withColumnsRenamed({"node": "u", "x": "_xu"}), [*on, "source", "u"])
        .join(counts.withColumnsRenamed({"node": "v", "x": "_xv"}), [*on, "source", "v"])
        .select(*on, "source", "u", "v", (F.col("_xu") / F.col("_xv")).alias("c"))
    )

    def back(wave: DataFrame) -> DataFrame:
        return (
            wave.withColumnRenamed("node", "v")
            .join(share, [*on, "source", "v"])
            .groupBy(*on, "source", F.col("u").alias("node"))
            .agg(F.sum(F.col("x") * F.col("c")).alias("x"))
        )

    first = cut_lineage(
        share.groupBy(*on, "source", F.col("u").alias("node")).agg(F.sum("c").alias("x"))
    )
    dependency = propagate(first, back)
    per_node = (
        dependency.where(F.col("source") != F.col("node"))
        .groupBy(*on, "node")
        .agg(F.sum("x").alias("_b"))
    )
    n = nodes.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    pairs = (F.col("_n") - 1.0) * (F.col("_n") - 2.0)
    return (
        nodes.select(*on, "node")
        .join(per_node, [*on, "node"], "left")
        .join(n, on)
        .select(
            *on, "node",
            F.when(pairs > 0, F.coalesce("_b", F.lit(0.0)) / pairs).otherwise(0.0).alias("value"),
        )
    )


# -- power iteration -----------------------------------------------------------


def _power_small(nodes, edges, keys, weighted: bool, max_iter: int):
    def run(names, i, j, weight, strength):
        n = len(names)
        w = strength if weighted else np.ones(len(i))
        A = np.zeros((n, n))
        A[i, j] = w
        A[j, i] = w
        x = np.full(n, 1.0 / n)
        done = len(i) == 0
        if len(i):
            for _ in range(max_iter):
                before = x
                x = before + A @ before
                norm = float(np.sqrt(x @ x)) or 1.0
                x = x / norm
                if np.abs(x - before).sum() < n * 1e-6:
                    done = True
                    break
        else:
            x = np.zeros(n)
        return pd.DataFrame({"node": names, "value": x, "converged": done})

    return graph_kernel(
        nodes,
        edges,
        keys,
        run,
        {
            "node": nodes.schema["node"].dataType,
            "value": T.DoubleType(),
            "converged": T.BooleanType(),
        },
    )


def _power_large(nodes, edges, keys, weighted: bool, max_iter: int):
    """The same iteration as joins, for graphs no task should hold."""
    on = list(keys)
    w = F.col("strength") if weighted else F.lit(1.0)
    arcs = cut_lineage(
        both_ways(edges, "strength").select(*on, "node", "other", w.alias("w"))
    )
    n = nodes.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    m = edges.groupBy(*on).agg(F.count(F.lit(1)).alias("_m"))
    sizes = cut_lineage(n.join(m, on, "left").fillna(0, ["_m"]))
    state = cut_lineage(
        nodes.select(*on, "node").join(sizes, on).select(
            *on, "node", (1.0 / F.col("_n")).alias("value"),
            (F.col("_m") == 0).alias("converged"),
        )
    )
    for _ in range(max_iter):
        pulled = (
            arcs.join(
                state.select(*on, F.col("node").alias("other"), F.col("value").alias("_v")),
                [*on, "other"],
            )
            .groupBy(*on, "node")
            .agg(F.sum(F.col("w") * F.col("_v")).alias("_in"))
        )
        raw = state.join(pulled, [*on, "node"], "left").withColumn(
            "_x", F.col("value") + F.coalesce("_in", F.lit(0.0))
        )
        raw = cut_lineage(raw)
        norm = raw.groupBy(*on).agg(F.sqrt(F.sum(F.col("_x") * F.col("_x"))).alias("_norm"))
        moved = raw.join(norm, on).withColumn("_new", F.col("_x") / F.col("_norm"))
        shift = (
            moved.groupBy(*on)
            .agg(F.sum(F.abs(F.col("_new") - F.col("value"))).alias("_shift"))
            .join(sizes, on)
            .select(
                *on,
                (F.col("_shift") < F.col("_n") * 1e-6).alias("_done"),
            )
        )
        keep = F.col("converged")
        state = cut_lineage(
            moved.join(shift, on).select(
                *on, "node",
                F.when(keep, F.col("value")).otherwise(F.col("_new")).alias("value"),
                (keep | F.col("_done")).alias("converged"),
            )
        )
        if is_empty(state.where(~F.col("converged"))):
            break
    return state


@keyless
def power_iteration(
    nodes: DataFrame, edges: DataFrame, keys: Keys, weighted: bool = True, max_iter: int = 1000
) -> DataFrame:
    """(keys, node, value, converged) of (A + I), small and large graphs."""
    small, large = split_by_size(nodes, edges, keys)
    result = _power_small(*small, keys, weighted, max_iter)
    if large:
        result = result.unionByName(_power_large(*large, keys, weighted, max_iter))
    return result


@keyless
def eigenvector_centrality(
    nodes: DataFrame, edges: DataFrame, keys: Keys, max_iter: int = 1000
) -> DataFrame:
    """(keys, node, value); graphs that do not converge get betweenness instead."""
    on = list(keys)
    x = power_iteration(nodes, edges, keys, True, max_iter)
    x = x.join(
        edges.select(*on).distinct().withColumn("_any", F.lit(True)), on, "left"
    ).withColumn("value", F.when(F.col("_any"), F.col("value")).otherwise(0.0))
    x = cut_lineage(x)
    failed = x.where(~F.col("converged")).select(*on).distinct()
    if is_empty(failed):
        return x.select(*on, "node", "value")
    other = betweenness(
        nodes.join(failed, on, "left_semi"), edges.join(failed, on, "left_semi"), keys
    )
    return x.where("converged").select(*on, "node", "value").unionByName(other)


def _radius_small(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    def run(names, i, j, weight, strength):
        del weight, strength
        A = np.zeros((len(names), len(names)))
        A[i, j] = A[j, i] = 1.0
        return pd.DataFrame({"spectral_radius": [float(np.abs(np.linalg.eigvalsh(A)).max())]})

    return graph_kernel(nodes, edges, keys, run, {"spectral_radius": T.DoubleType()})


def _radius_large(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """The squared length of the leading direction, which the embedding scales by the root of its eigenvalue."""
    on = list(keys)
    tag = nodes.select(*on).distinct().withColumn("g", F.xxhash64(*on)).withColumn("g", F.dense_rank().over(Window.orderBy("g", *on)))
    numbers = cut_lineage(tag.withColumn("g", F.col("g").cast("int")))
    named = cut_lineage(
        nodes.join(numbers, on).select("g", "node", F.lit(1 + spectral.OVERSAMPLE).alias("p"), F.monotonically_increasing_id().alias("id"))
    )
    arcs = edges.join(numbers, on).select("g", "src", "dst").distinct()
    for end in ("src", "dst"):
        arcs = arcs.join(named.select("g", F.col("node").alias(end), F.col("id").alias(f"_{end}")), ["g", end]).drop(end).withColumnRenamed(f"_{end}", end)
    own = named.select("g", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("w"))
    one = arcs.select("g", "src", "dst", F.lit(1.0).alias("w"))
    both = cut_lineage(one.unionByName(one.select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).unionByName(own))
    sizes = {r.g: (1 + spectral.OVERSAMPLE, 1) for r in numbers.select("g").collect()}  # a row for each large graph
    points = spectral.embedding(named, both, sizes)
    length = points.groupBy("g").agg(F.sum(F.col("vec")[0] * F.col("vec")[0]).alias("spectral_radius"))
    return numbers.join(length, "g").select(*on, "spectral_radius")


@keyless
def spectral_radius(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Largest absolute eigenvalue of the 0/1 adjacency matrix, of small and large graphs."""
    small, large = split_by_size(nodes, edges, keys)
    result = _radius_small(*small, keys)
    if large:
        result = result.unionByName(_radius_large(*large, keys))
    return result


@keyless
def node_centrality(
    nodes: DataFrame, edges: DataFrame, keys: Keys, centrality: str
) -> DataFrame:
    ways = {
        "eigenvector": eigenvector_centrality,
        "betweenness": betweenness,
        "degree": degree_centrality,
    }
    if centrality not in ways:
        raise ValueError(f"unknown centrality {centrality!r}")
    return ways[centrality](nodes, edges, keys)


# -- mixing --------------------------------------------------------------------


@keyless
def degree_mixing(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """degree_assortativity and avg_neighbor_degree (isolated nodes count 0)."""
    on = list(keys)
    deg = degrees(nodes, edges, keys).select(*on, "node", "degree")
    ends = (
        both_ways(edges)
        .join(deg.withColumnRenamed("degree", "_du"), [*on, "node"])
        .join(
            deg.select(*on, F.col("node").alias("other"), F.col("degree").alias("_dv")),
            [*on, "other"],
        )
    )
    u, v = F.col("_du").cast("double"), F.col("_dv").cast("double")
    mix = ends.groupBy(*on).agg(
        safe_corr(u, v).alias("degree_assortativity")
    )
    around = ends.groupBy(*on, "node").agg(F.avg(v).alias("_avg"))
    near = (
        deg.join(around, [*on, "node"], "left")
        .groupBy(*on)
        .agg(F.avg(F.coalesce("_avg", F.lit(0.0))).alias("avg_neighbor_degree"))
    )
    return near.join(mix, on, "left")


@keyless
def modularity(
    edges: DataFrame, membership: DataFrame, keys: Keys, weight: str | None = "weight"
) -> DataFrame:
    """Modularity of a given partition (keys, node, community)."""
    on = list(keys)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    e = edges.select(*on, "src", "dst", w.alias("w"))
    own = membership.select(*on, "node", "community")
    tagged = e.join(
        own.select(*on, F.col("node").alias("src"), F.col("community").alias("_cs")), [*on, "src"]
    ).join(own.select(*on, F.col("node").alias("dst"), F.col("community").alias("_cd")), [*on, "dst"])
    ends = tagged.select(
        *on,
        F.explode(
            F.array(
                F.struct(F.col("_cs").alias("community"), F.col("w"),
                         F.when(F.col("_cs") == F.col("_cd"), F.col("w")).otherwise(0.0).alias("inside")),
                F.struct(F.col("_cd").alias("community"), F.col("w"), F.lit(0.0).alias("inside")),
            )
        ).alias("x"),
    ).select(*on, "x.*")
    per = ends.groupBy(*on, "community").agg(
        F.sum("w").alias("_deg"), F.sum("inside").alias("_in")
    )
    total = per.groupBy(*on).agg(
        F.sum("_deg").alias("_two_m"),
        F.sum("_in").alias("_in"),
        F.sum(F.col("_deg") * F.col("_deg")).alias("_sq"),
    )
    m2 = F.col("_two_m")
    return total.select(
        *on,
        F.when(m2 != 0, 2.0 * F.col("_in") / m2 - F.col("_sq") / (m2 * m2)).alias("modularity"),
    )


# -- cliques -------------------------------------------------------------------


def _peeled(near: list[int]) -> list[int]:
    """Nodes in the order in which the one with the fewest neighbours left is taken off."""
    left = [bits.bit_count() for bits in near]
    buckets: dict[int, set[int]] = {}
    for v, d in enumerate(left):
        buckets.setdefault(d, set()).add(v)
    order, gone, least = [], 0, 0
    while len(order) < len(near):
        least = max(0, least - 1)
        while not buckets.get(least):
            least += 1
        v = buckets[least].pop()
        order.append(v)
        gone |= 1 << v
        rest = near[v] & ~gone
        while rest:
            u = (rest & -rest).bit_length() - 1
            rest &= rest - 1
            buckets[left[u]].discard(u)
            left[u] -= 1
            buckets.setdefault(left[u], set()).add(u)
    return order


def _members(bits: int):
    while bits:
        yield (bits & -bits).bit_length() - 1
        bits &= bits - 1


def count_cliques(near: list[int]) -> int:
    """Maximal cliques of a graph whose neighbourhoods are bit sets.

    Roots follow the peeling order, so that no branch starts with more
    candidates than the degeneracy; a branch leaves out the neighbours of the
    node that has most of its candidates.
    """
    found, earlier = 0, 0
    for root in _peeled(near):
        stack = [(near[root] & ~earlier, near[root] & earlier)]
        earlier |= 1 << root
        while stack:
            candidates, excluded = stack.pop()
            if not candidates:
                found += not excluded
                continue
            pivot = max(_members(candidates | excluded), key=lambda v: (near[v] & candidates).bit_count())
            for v in _members(candidates & ~near[pivot]):
                stack.append((candidates & near[v], excluded & near[v]))
                candidates &= ~(1 << v)
                excluded |= 1 << v
    return found


def _cliques_small(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    def run(names, i, j, weight, strength):
        del weight, strength
        near = [0] * len(names)
        for a, b in zip(i.tolist(), j.tolist(), strict=True):
            near[a] |= 1 << b
            near[b] |= 1 << a
        return pd.DataFrame({"n_cliques": [count_cliques(near)]})

    return graph_kernel(nodes, edges, keys, run, {"n_cliques": T.LongType()})


@keyless
def maximal_cliques(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """(keys, n_cliques) of small and large graphs."""
    small, large = split_by_size(nodes, edges, keys)
    result = _cliques_small(*small, keys)
    if large:
        result = result.unionByName(_cliques_large(*large, keys))
    return result


def _cliques_large(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Branches of the search tree are rows, one level per round.

    A row holds the candidates and the excluded nodes of one partial clique, so
    its size is bounded by a neighbourhood, and levels by the largest clique.
    """
    on = list(keys)
    adjacency = cut_lineage(
        both_ways(edges).groupBy(*on, "node").agg(F.collect_set("other").alias("near"))
    )
    roots = nodes.select(*on, "node").join(adjacency, [*on, "node"], "left")
    alone = roots.where(F.col("near").isNull())
    later = F.filter("near", lambda x: x > F.col("node"))
    earlier = F.filter("near", lambda x: x < F.col("node"))
    branch = cut_lineage(
        roots.where(F.col("near").isNotNull()).select(*on, later.alias("P"), earlier.alias("X"))
    )
    counts = [alone.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))]
    lookup = adjacency.select(*on, F.col("node").alias("v"), "near")
    while True:
        ends = branch.where((F.size("P") == 0) & (F.size("X") == 0))
        counts.append(ends.groupBy(*on).agg(F.count(F.lit(1)).alias("n")))
        grow = branch.where(F.size("P") > 0)
        if is_empty(grow):
            break
        pivoted = (
            grow.withColumn("v", F.element_at(F.concat("X", "P"), 1))
            .join(lookup, [*on, "v"])
            .withColumn("todo", F.array_sort(F.array_except("P", "near")))
            .select(*on, "P", "X", "todo")
        )
        children = pivoted.select(
            *on, "P", "X", "todo", F.posexplode("todo").alias("at", "v")
        ).join(lookup, [*on, "v"])
        done = F.slice("todo", F.lit(1), F.col("at"))
        branch = cut_lineage(
            children.select(
                *on,
                F.array_intersect(F.array_except("P", done), "near").alias("P"),
                F.array_intersect(F.array_union("X", done), "near").alias("X"),
            )
        )
    total = counts[0]
    for c in counts[1:]:
        total = total.unionByName(c)
    return total.groupBy(*on).agg(F.sum("n").alias("n_cliques"))


# -- greedy modularity ---------------------------------------------------------


def _greedy_small(nodes, edges, keys):
    def run(names, i, j, weight, strength):
        del weight, strength
        n, m = len(names), len(i)
        label = np.arange(n)
        if m:
            E = np.zeros((n, n))
            E[i, j] = E[j, i] = 1.0 / (2.0 * m)
            a = E.sum(axis=1)
            alive = np.ones(n, dtype=bool)
            while True:
                gain = np.where(
                    (E > 0) & alive[:, None] & alive[None, :], 2.0 * (E - np.outer(a, a)), -np.inf
                )
                np.fill_diagonal(gain, -np.inf)
                gain = np.round(gain, 12)
                best = gain.max()
                if not best > 0:
                    break
                u, v = np.argwhere(gain == best)[0]
                E[v] += E[u]
                E[:, v] += E[:, u]
                a[v] += a[u]
                alive[u] = False
                label[label == u] = v
        return pd.DataFrame({"node": names, "community": names[label]})

    kind = nodes.schema["node"].dataType
    return graph_kernel(nodes, edges, keys, run, {"node": kind, "community": kind})


def _greedy_large(nodes, edges, keys):
    """One merge per graph and round, on community sums."""
    on = list(keys)
    m2 = edges.groupBy(*on).agg((F.count(F.lit(1)) * 2.0).alias("_m2"))
    links = cut_lineage(
        both_ways(edges).join(m2, on).select(
            *on, F.col("node").alias("u"), F.col("other").alias("v"),
            (1.0 / F.col("_m2")).alias("e"),
        )
    )
    label = cut_lineage(nodes.select(*on, "node", F.col("node").alias("community")))
    mass = cut_lineage(links.groupBy(*on, F.col("u").alias("c")).agg(F.sum("e").alias("a")))
    while True:
        gain = (
            links.where(F.col("u") < F.col("v"))
            .join(mass.withColumnsRenamed({"c": "u", "a": "_au"}), [*on, "u"])
            .join(mass.withColumnsRenamed({"c": "v", "a": "_av"}), [*on, "v"])
            .withColumn("g", F.round(2.0 * (F.col("e") - F.col("_au") * F.col("_av")), 12))
            .where(F.col("g") > 0)
        )
        best = cut_lineage(
            gain.groupBy(*on)
            .agg(F.min(F.struct((-F.col("g")).alias("g"), "u", "v")).alias("_b"))
            .select(*on, F.col("_b.u").alias("_from"), F.col("_b.v").alias("_to"))
        )
        if is_empty(best):
            return label

        def moved(df, column, best=best):
            return df.join(best, on, "left").withColumn(
                column,
                F.when(F.col(column) == F.col("_from"), F.col("_to")).otherwise(F.col(column)),
            )

        renamed = moved(moved(links, "u").drop("_from", "_to"), "v").drop("_from", "_to")
        links = cut_lineage(renamed.groupBy(*on, "u", "v").agg(F.sum("e").alias("e")))
        mass = cut_lineage(moved(mass, "c").groupBy(*on, "c").agg(F.sum("a").alias("a")))
        label = cut_lineage(moved(label, "community").drop("_from", "_to"))


@keyless
def greedy_communities(nodes: DataFrame, edges: DataFrame, keys: Keys) -> DataFrame:
    """Greedy agglomerative modularity, unweighted: (keys, node, community).

    Best gain first; equal gains take the least pair of communities.
    """
    small, large = split_by_size(nodes, edges, keys)
    result = _greedy_small(*small, keys)
    if large:
        result = result.unionByName(_greedy_large(*large, keys))
    return result


# -- summaries -----------------------------------------------------------------


@keyless
def network_summary(
    nodes: DataFrame, edges: DataFrame, keys: Keys, extended: bool = True
) -> DataFrame:
    """One row per graph: sizes, components, clustering and giant-component paths."""
    on = list(keys)
    labels = components(nodes, edges, keys)
    rows = (
        size_summary(nodes, edges, keys)
        .join(component_summary(labels, keys), on, "left")
        .join(clustering(nodes, edges, keys), on, "left")
    )
    if extended:
        rows = rows.join(path_summary(nodes, edges, keys, labels), on, "left")
    return rows


@keyless
def node_metric_rows(
    nodes: DataFrame, edges: DataFrame, keys: Keys, centrality: str = "degree"
) -> DataFrame:
    """Long (keys, node, metric, value): weighted_degree and the chosen centrality."""
    on = [*keys, "node"]
    strength = degrees(nodes, edges, keys).select(
        *on, F.lit("weighted_degree").alias("metric"),
        F.col("weighted_degree").cast("double").alias("value"),
    )
    central = node_centrality(nodes, edges, keys, centrality).select(
        *on, F.lit(centrality).alias("metric"), F.col("value").cast("double").alias("value")
    )
    return strength.unionByName(central)
