"""Small graphs whose metrics are known, and large-graph paths against small ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stratanet.operators import communities as C
from stratanet.operators import graph as G
from stratanet.operators import metrics as H
from stratanet.operators.pairs import Roles, measure_pairs

KEYS = ("layer",)


@pytest.fixture(scope="module")
def known(spark):
    """g: triangle a-b-c, tail c-d, isolated e.  p: path of six."""
    edges = [("g", "a", "b"), ("g", "b", "c"), ("g", "a", "c"), ("g", "c", "d")]
    edges += [("p", f"n{i}", f"n{i + 1}") for i in range(5)]
    e = spark.createDataFrame(edges, "layer string, src string, dst string")
    e = e.withColumn("weight", F.lit(0.5)).withColumn("strength", F.lit(0.5))
    nodes = [("g", n) for n in "abcde"] + [("p", f"n{i}") for i in range(6)]
    return spark.createDataFrame(nodes, "layer string, node string"), e


def by_layer(df, *columns):
    return {r["layer"]: tuple(r[c] for c in columns) for r in df.collect()}


def by_node(df, layer, column="value"):
    return {r["node"]: r[column] for r in df.where(F.col("layer") == layer).collect()}


def test_summary_of_known_graphs(known):
    row = H.network_summary(*known, KEYS)
    got = by_layer(row, "n_components", "largest_component_size", "n_triangles", "diameter", "radius")
    assert got == {"g": (2, 4, 1, 2.0, 1.0), "p": (1, 6, 0, 5.0, 3.0)}
    clustering = by_layer(row, "avg_clustering", "transitivity")
    assert clustering["g"] == pytest.approx(((1 + 1 + 1 / 3) / 5, 3 / 5))
    assert clustering["p"] == (0.0, None)


def test_components_and_paths_small_and_large_agree(known, monkeypatch):
    def both():
        labels = H.components(*known, KEYS)
        rows = H.path_summary(*known, KEYS, labels)
        names = [c for c in rows.columns if c != "layer"]
        return sorted(map(tuple, labels.collect())), by_layer(rows, *names)

    small = both()
    monkeypatch.setattr(H, "TASK_NODES", 2)
    assert both() == small


def test_betweenness_of_a_path(known):
    got = by_node(H.betweenness(*known, KEYS), "p")
    want = [0, 4, 6, 6, 4, 0]
    assert [got[f"n{i}"] * 10 for i in range(6)] == pytest.approx(want)


def test_power_iteration_small_and_large_paths_agree(known, monkeypatch):
    small = by_node(H.power_iteration(*known, KEYS, max_iter=4), "g")
    monkeypatch.setattr(H, "TASK_NODES", 2)
    large = by_node(H.power_iteration(*known, KEYS, max_iter=4), "g")
    assert large == pytest.approx(small, abs=1e-9)
    assert small["c"] == max(small.values())


def test_greedy_small_and_large_paths_agree(known, monkeypatch):
    def parts(df):
        groups = {}
        for r in df.collect():
            groups.setdefault((r["layer"], r["community"]), set()).add(r["node"])
        return sorted(map(sorted, groups.values()))

    small = parts(H.greedy_communities(*known, KEYS))
    monkeypatch.setattr(H, "TASK_NODES", 2)
    assert parts(H.greedy_communities(*known, KEYS)) == small


def test_cliques_and_radius(known):
    assert by_layer(H.maximal_cliques(*known, KEYS), "n_cliques") == {"g": (3,), "p": (5,)}
    radius = by_layer(H.spectral_radius(*known, KEYS), "spectral_radius")
    assert radius["p"][0] == pytest.approx(1.8019377358, abs=1e-6)


def test_isolated_nodes_keep_degree_zero(known):
    assert by_node(G.degrees(*known, KEYS), "g", "degree") == {"a": 2, "b": 2, "c": 3, "d": 1, "e": 0}


def test_perfect_and_undefined_pairs(spark):
    rows = []
    for t in range(6):
        rows += [("l", f"2020-01-0{t + 1}", "a", float(t)), ("l", f"2020-01-0{t + 1}", "b", 2.0 * t)]
        rows.append(("l", f"2020-01-0{t + 1}", "flat", 1.0))
    rows += [("l", "2020-01-01", "short", 3.0), ("l", "2020-01-02", "short", 1.0)]
    panel = spark.createDataFrame(rows, "layer string, dt string, node string, value double")
    got = {
        (r["node_i"], r["node_j"]): r["measure"]
        for r in measure_pairs(panel, "pearson_correlation").collect()
    }
    assert got[("a", "b")] == pytest.approx(1.0)
    assert got[("a", "flat")] is None and got[("a", "short")] is None
    edges = G.threshold_edges(measure_pairs(panel, "pearson_correlation"), 0.33)
    assert [(r["src"], r["dst"]) for r in edges.collect()] == [("a", "b")]


def test_tiling_does_not_change_pairs(spark, monkeypatch):
    from stratanet.operators import pairs as X

    panel = spark.range(40 * 9).select(
        F.lit("l").alias("layer"), (F.col("id") % 9).alias("node"),
        F.floor(F.col("id") / 9).alias("dt"), F.rand(3).alias("value"),
    )
    panel = panel.where("value > 0.1").cache()

    def table(measure):
        return {
            (r["node_i"], r["node_j"]): (r["n_obs"], round(r["measure"], 9))
            for r in measure_pairs(panel, measure, Roles()).collect()
        }

    whole = {m: table(m) for m in ("pearson_correlation", "chatterjee_xi", "kendall_tau")}
    monkeypatch.setattr(X, "BLOCK_NODES", 2)
    monkeypatch.setattr(X, "SLICE_DATES", 7)
    for m, want in whole.items():
        got = table(m)
        assert len(want) == 36 and {k: v[0] for k, v in got.items()} == {
            k: v[0] for k, v in want.items()
        }
        assert {k: v[1] for k, v in got.items()} == pytest.approx(
            {k: v[1] for k, v in want.items()}, abs=1e-8
        )


def test_planted_communities_and_alignment(spark):
    edges = []
    for layer in ("1Y", "2Y"):
        for lo in ("a", "b"):
            names = [f"{lo}{i}" for i in range(5)]
            edges += [(layer, u, v) for i, u in enumerate(names) for v in names[i + 1 :]]
        edges.append((layer, "a0", "b0"))
    e = spark.createDataFrame(edges, "layer string, src string, dst string")
    e = e.withColumn("weight", F.lit(0.5)).withColumn("strength", F.lit(0.5))
    nodes = spark.createDataFrame(
        [(y, f"{c}{i}") for y in ("1Y", "2Y") for c in "ab" for i in range(5)],
        "layer string, node string",
    )
    table = C.community_matrix(nodes, e, "MODULARITY").collect()
    labels = {}
    for r in table:
        labels.setdefault(r["node"][0], set()).add(r["community"])
    assert len(table) == 20 and all(len(v) == 1 for v in labels.values())
    assert labels["a"] != labels["b"]
