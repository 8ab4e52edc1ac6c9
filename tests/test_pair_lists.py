"""Pairs leave their tiles finished, in lists by their first node, and are the same pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratanet.operators import pairs as X
from stratanet.operators.pairs import Roles


def sparse_panel(spark):
    """Two keys; one in three values is absent, one node is flat and one has two dates."""
    rng = np.random.default_rng(4)
    rows = [
        (k, y, n, d, 2.5 if n == 7 else float(rng.normal()))
        for k, y in ((1, "a"), (2, "a"), (2, None)) for n in range(12) for d in range(9)
        if (rng.random() > 0.33 and n != 5) or (n == 5 and d < 2)
    ]
    return spark.createDataFrame(rows, "k int, layer string, node long, dt int, value double")


def expected(panel):
    wide: dict = {}
    for r in panel.collect():
        wide.setdefault((r["k"], r["layer"]), {}).setdefault(r["node"], {})[r["dt"]] = r["value"]
    out = {}
    for key, nodes in wide.items():
        for i in nodes:
            for j in nodes:
                both = sorted(nodes[i].keys() & nodes[j].keys())
                if i < j and both:
                    x, y = (np.array([nodes[n][d] for d in both]) for n in (i, j))
                    flat = len(both) < 3 or np.ptp(x) == 0 or np.ptp(y) == 0
                    out[(*key, i, j)] = len(both), None if flat else np.corrcoef(x, y)[0, 1]
    return out


@pytest.mark.parametrize("nodes_of_a_block", [128, 1])
def test_listed_pairs_are_those_of_brute_force(spark, monkeypatch, nodes_of_a_block):
    monkeypatch.setattr(X, "BLOCK_NODES", nodes_of_a_block)
    panel = sparse_panel(spark)
    roles = Roles(keys=("k", "layer"))
    rows = X.measure_pairs(panel, "pearson_correlation", roles).collect()
    got = {(r["k"], r["layer"], r["node_i"], r["node_j"]): (r["n_obs"], r["measure"]) for r in rows}
    want = expected(panel)
    assert len(rows) == len(got) and got.keys() == want.keys()
    for key, (n, r) in want.items():
        assert got[key] == (n, None) if r is None else got[key] == (n, pytest.approx(r, abs=1e-9))


@pytest.mark.parametrize("nodes_of_a_block", [128, 1])
def test_sums_of_a_pair_keep_their_sides(spark, monkeypatch, nodes_of_a_block):
    monkeypatch.setattr(X, "BLOCK_NODES", nodes_of_a_block)
    panel = sparse_panel(spark).where("k = 1").drop("k")
    series: dict = {}
    for r in panel.collect():
        series.setdefault(r["node"], {})[r["dt"]] = r["value"]
    for r in X.pair_sums(panel, Roles(), self_pairs=True).collect():
        x, y = series[r["node_i"]], series[r["node_j"]]
        both = x.keys() & y.keys()
        assert r["node_i"] <= r["node_j"] and r["n"] == len(both)
        for name, want in (("sx", x), ("sy", y)):
            assert r[name] == pytest.approx(sum(want[d] for d in both))
            assert r[name + name[1]] == pytest.approx(sum(want[d] ** 2 for d in both))


def test_tiles_give_lists_of_measures_and_no_sums(spark, monkeypatch):
    panel = X.written(sparse_panel(spark), "panel")
    for width in (128, 1):
        monkeypatch.setattr(X, "BLOCK_NODES", width)
        plan = X.pearson(panel, Roles(keys=("k", "layer")))._jdf.queryExecution().executedPlan().toString()
        assert "posexplode(node_j" in plan and "sxx" not in plan


def test_infinite_values_are_compared_as_in_sql(spark):
    """A pair with an infinite value has what the sums gave by themselves."""
    panel = sparse_panel(spark).where("k = 1").withColumn("value", F.when(F.expr("node = 3 and dt < 4"), F.lit(float("inf"))).otherwise(F.col("value")))
    roles, keys = Roles(keys=("k", "layer")), ["k", "layer", "node_i", "node_j", "n"]
    sums = X.pair_totals(panel, roles, centred=True).select(*keys, X.correlation_of_sums().alias("measure"))
    found = X.pair_totals(panel, roles, centred=True, correlation=True)
    a, b = ({tuple(r[k] for k in keys): r["measure"] for r in t.collect()} for t in (sums, found))
    assert a == b
