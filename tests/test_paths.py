"""Paths and betweenness against brute force, of small graphs and of those over the bound."""

from __future__ import annotations

import random

import pytest

from stratanet.operators import metrics as H

KEYS = ("layer",)
SCHEMA = "layer string, src string, dst string, weight double, strength double"


def random_graphs(seed):
    rng = random.Random(seed)
    out = {}
    for layer, (n, p) in {"a": (12, 0.25), "b": (9, 0.5), "c": (6, 0.0), "d": (2, 1.0)}.items():
        names = [f"v{i:02d}" for i in range(n)]
        # Few distinct weights, some zero, so that many paths are equally long up to rounding.
        edges = {(u, v): rng.choice([0.0, 0.1, 0.2, 0.3, 0.3]) for i, u in enumerate(names) for v in names[i + 1 :] if rng.random() < p}
        out[layer] = names, edges
    return out


def tables(spark, graphs):
    nodes = spark.createDataFrame([(y, v) for y, (names, _) in graphs.items() for v in names], "layer string, node string")
    edges = [(y, u, v, w, 1.0) for y, (_, e) in graphs.items() for (u, v), w in e.items()]
    return nodes, spark.createDataFrame(edges, SCHEMA)


def brute(names, edges):
    """Distances by trying all detours, path counts by the arcs that lie on a shortest path."""
    w = {}
    for (u, v), x in edges.items():
        w[u, v] = w[v, u] = max(x, 1e-12)
    d = {(u, v): 0.0 if u == v else w.get((u, v), float("inf")) for u in names for v in names}
    for k in names:
        for u in names:
            for v in names:
                d[u, v] = min(d[u, v], d[u, k] + d[k, v])

    def equal(x, y):
        return x < float("inf") and abs(x - y) <= 1e-14 * max(x, y)

    paths = {}
    for s in names:
        for v in sorted(names, key=lambda v: d[s, v]):
            before = [u for u in names if (u, v) in w and equal(d[s, u] + w[u, v], d[s, v]) and d[s, u] < d[s, v]]
            paths[s, v] = 1.0 if s == v else sum(paths[s, u] for u in before)
    n, out = len(names), {}
    for v in names:
        total = 0.0
        for s in names:
            for t in names:
                if len({s, t, v}) == 3 and d[s, t] < float("inf") and equal(d[s, v] + d[v, t], d[s, t]):
                    total += paths[s, v] * paths[v, t] / paths[s, t]
        out[v] = total / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bound", [2000, 2])
def test_betweenness_equals_brute_force(spark, monkeypatch, seed, bound):
    monkeypatch.setattr(H, "TASK_NODES", bound)
    graphs = random_graphs(seed)
    got = {(r["layer"], r["node"]): r["value"] for r in H.betweenness(*tables(spark, graphs), KEYS).collect()}
    want = {(y, v): b for y, g in graphs.items() for v, b in brute(*g).items()}
    assert got.keys() == want.keys()
    assert got == pytest.approx(want, abs=1e-9)


def test_sources_in_batches_give_the_same():
    import numpy as np

    i, j = np.array([0, 1, 2, 0, 4]), np.array([1, 2, 3, 3, 5])
    arcs = H._sorted_arcs(7, i, j, np.array([1.0, 1.0, 1.0, 2.5, 1.0]))
    whole = H._distances(7, arcs, np.arange(7))
    assert whole[3].tolist()[:4] == [2.5, 2.0, 1.0, 0.0] and whole[5, 4] == 1.0 and np.isinf(whole[6, :6]).all()
    for v in range(7):
        assert np.array_equal(H._distances(7, arcs, np.array([v]))[:, 0], whole[:, v])


def test_betweenness_of_small_graphs_is_one_job_per_table(spark):
    nodes, edges = tables(spark, random_graphs(3))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("between", "")
    H.betweenness(nodes, edges, KEYS).collect()
    jobs = tracker.getJobIdsForGroup("between")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 10


def all_cliques(names, edges):
    """Maximal cliques by trying every set of nodes."""
    from itertools import combinations

    linked = lambda u, v: (u, v) in edges or (v, u) in edges
    cliques = [set(c) for k in range(1, len(names) + 1) for c in combinations(names, k) if all(linked(u, v) for u, v in combinations(c, 2))]
    return sum(not any(c < d for d in cliques) for c in cliques)


@pytest.mark.parametrize("bound", [2000, 2])
def test_cliques_equal_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(H, "TASK_NODES", bound)
    graphs = random_graphs(4)
    got = {r["layer"]: r["n_cliques"] for r in H.maximal_cliques(*tables(spark, graphs), KEYS).collect()}
    assert got == {y: all_cliques(*g) for y, g in graphs.items()}


def test_cliques_of_known_graphs():
    full = [(1 << 9) - 1 & ~(1 << v) for v in range(9)]
    assert H.count_cliques(full) == 1
    # Three groups of three without edges inside: any choice of one from each.
    parts = [sum(1 << u for u in range(9) if u // 3 != v // 3) for v in range(9)]
    assert H.count_cliques(parts) == 27
    assert H.count_cliques([0, 0]) == 2 and H.count_cliques([]) == 0
    star = [0b11110, 1, 1, 1, 1]
    assert H.count_cliques(star) == 4 and H._peeled(star)[-1] in (0, 1, 2, 3, 4)
