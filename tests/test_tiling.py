"""How finely a key is cut follows its own nodes and dates, and changes no result."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratanet.operators import pairs as X
from stratanet.operators.pairs import Roles


def panel_of(spark, layers):
    """A full panel of random values: {layer: (nodes, dates)}."""
    rng = np.random.default_rng(0)
    rows = [(y, f"n{i:03d}", d, float(rng.normal())) for y, (n, t) in layers.items() for i in range(n) for d in range(t)]
    return spark.createDataFrame(rows, "layer string, node string, dt int, value double")


def test_a_small_layer_beside_a_large_one_is_one_tile(spark):
    large = spark.range(5000).select(F.lit("large").alias("layer"), F.col("id").cast("string").alias("node"), F.lit(1).alias("dt"), F.rand(1).alias("value"))
    panel = large.unionByName(panel_of(spark, {"small": (5, 50)}))
    for sliced in (True, False):
        placed = X.tiles(panel, Roles(), X.tile_sizes(panel, Roles(), sliced))
        small = placed.where("layer = 'small'")
        assert small.count() == 250
        assert small.select("tile_a", "tile_b", "slice").distinct().count() == 1
        assert placed.where("layer = 'large'").select("tile_a").distinct().count() > 5


def test_short_and_long_keys_are_added_up_alike(spark, monkeypatch):
    monkeypatch.setattr(X, "SLICE_DATES", 7)
    monkeypatch.setattr(X, "BLOCK_NODES", 1)
    panel = panel_of(spark, {"short": (5, 6), "long": (6, 40)}).where("(dt + length(node)) % 11 != 3 or node != 'n002'")
    got = {(r["layer"], r["node_i"], r["node_j"]): (r["n_obs"], r["measure"]) for r in X.measure_pairs(panel, "pearson_correlation", Roles()).collect()}
    wide: dict = {}
    for r in panel.collect():
        wide.setdefault(r["layer"], {}).setdefault(r["node"], {})[r["dt"]] = r["value"]
    want = {}
    for layer, nodes in wide.items():
        for i in nodes:
            for j in nodes:
                both = sorted(nodes[i].keys() & nodes[j].keys())
                if i < j:
                    want[layer, i, j] = len(both), float(np.corrcoef([nodes[i][d] for d in both], [nodes[j][d] for d in both])[0, 1])
    assert got.keys() == want.keys()
    for k, (n, r) in want.items():
        assert got[k][0] == n and got[k][1] == pytest.approx(r, abs=1e-9)


def test_pairs_of_one_slice_are_not_shuffled_again(spark):
    panel = panel_of(spark, {"a": (4, 9)})
    plan = X.pearson(panel, Roles())._jdf.queryExecution().toString()
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Aggregate" not in above



def test_groups_of_packed_blocks_give_the_pairs_of_one_tile(spark, monkeypatch):
    panel = panel_of(spark, {"large": (24, 20), "small": (2, 5)}).where("(dt + length(node) + hash(node)) % 7 != 3")

    def pairs(measure):
        rows = X.measure_pairs(panel, measure, Roles()).collect()
        found = {(r["layer"], r["node_i"], r["node_j"]): (r["n_obs"], r["measure"]) for r in rows}
        assert len(rows) == len(found)
        return found

    names = ("pearson_correlation", "spearman_correlation", "chatterjee_xi")
    whole = [pairs(m) for m in names]
    copies, copied = [], X._copied
    monkeypatch.setattr(X, "_copied", lambda *a: copies.append(copied(*a)) or copies[-1])
    monkeypatch.setattr(X, "BLOCK_NODES", 1)
    monkeypatch.setattr(X, "GROUP_NODES", 8)
    for measure, want in zip(names, whole, strict=True):
        got = pairs(measure)
        assert got.keys() == want.keys()
        for key, (n, value) in want.items():
            assert got[key][0] == n and got[key][1] == pytest.approx(value, abs=1e-6, nan_ok=True)
    # A row is copied only when it is packed: fewer copies than panel rows, not several for each of them.
    large = [c.where("layer = 'large'").count() for c in copies]
    assert len([n for n in large if n]) == 3 and max(large) <= 24 * 6 < panel.count()


def test_pair_counts_are_not_shuffled_by_pair(spark, sf_dir):
    from stratanet.catalog.measures import j6

    plan = j6(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Aggregate" not in plan[: plan.index("FlatMapGroupsInArrow")]


def test_packed_blocks_are_read_beside_each_other_and_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(X, "BLOCK_NODES", 1)
    panel = X.written(panel_of(spark, {"large": (24, 20)}), "panel")
    for measure in (X.pearson, X.MEASURES["spearman_correlation"].build):
        plan = measure(panel, Roles())._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_keys_of_one_slice_are_centred_in_their_tiles(spark):
    panel = X.written(panel_of(spark, {"a": (4, 9)}).withColumn("value", F.col("value") + 1e7), "panel")
    found = X.pearson(panel, Roles())
    # The only shuffle is that to the tiles.
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    wide: dict = {}
    for r in panel.collect():
        wide.setdefault(r["node"], {})[r["dt"]] = r["value"]
    for r in found.collect():
        x, y = (np.array([wide[r[n]][d] for d in range(9)]) for n in ("node_i", "node_j"))
        assert r["measure"] == pytest.approx(np.corrcoef(x - x.mean(), y - y.mean())[0, 1], abs=1e-7)
