"""Rank and distance measures of long series, in n log n, against those over all pairs of dates."""

from __future__ import annotations

import time

import numpy as np
import pytest

from stratanet.operators import kernels as K
from stratanet.operators.pairs import Roles, measure_pairs


def blocks(seed, n, ties):
    rng = np.random.default_rng(seed)
    X, Y = rng.normal(size=(n, 3)), rng.normal(size=(n, 4))
    Y[:, 0] += X[:, 0]
    Y[:, 1] = -X[:, 1] ** 2
    if ties:
        X, Y = np.round(X * 2), np.round(Y)
    X[rng.random(X.shape) < 0.2] = np.nan
    Y[rng.random(Y.shape) < 0.1] = np.nan
    X[:, 2] = 1.0  # flat
    Y[2:, 3] = np.nan  # too few dates in common
    return X, Y


@pytest.mark.parametrize("name", ["spearman", "kendall", "distance_correlation"])
@pytest.mark.parametrize("ties", [False, True])
@pytest.mark.parametrize("n", [1, 2, 37, 64, 130])
def test_sorted_and_banded_forms_agree(monkeypatch, name, ties, n):
    X, Y = blocks(n, n, ties)
    want = getattr(K, name)(X, Y)
    monkeypatch.setattr(K, "BAND_DATES", 0)
    monkeypatch.setattr(K, "WORK_CELLS", 16 * n)
    got = getattr(K, name)(X, Y)
    assert np.array_equal(got[1], want[1])
    # Single precision in the bands; a root of almost nothing in both.
    assert np.allclose(got[0], want[0], atol=1e-6 if name != "distance_correlation" else 1e-7, equal_nan=True)


def test_sums_over_earlier_rows_that_are_not_larger():
    rng = np.random.default_rng(1)
    V, W = np.round(rng.normal(size=(45, 3)) * 2), rng.normal(size=(45, 3))
    (got,) = K._earlier(V, [W])
    for c in range(3):
        assert got[:, c] == pytest.approx([W[:i, c][V[:i, c] <= V[i, c]].sum() for i in range(45)])


def test_a_hundred_thousand_dates_have_no_band_of_squares():
    rng = np.random.default_rng(2)
    X = rng.normal(size=(100_000, 1))
    Y = np.hstack([X + rng.normal(size=X.shape), rng.normal(size=X.shape)])
    began = time.time()
    for fn, first in ((K.spearman, 0.69), (K.kendall, 0.5), (K.distance_correlation, 0.66)):
        value, n = fn(X, Y)
        assert n.tolist() == [[100_000, 100_000]]
        assert value[0, 0] == pytest.approx(first, abs=0.02) and value[0, 1] < 0.02
    assert time.time() - began < 120


def test_measures_of_a_panel_do_not_depend_on_the_form(spark):
    rng = np.random.default_rng(3)
    rows = [("a", f"n{i}", d, float(np.round(rng.normal(), 1))) for i in range(5) for d in range(60) if rng.random() < 0.9]
    panel = spark.createDataFrame(rows, "layer string, node string, dt int, value double")

    def values(measure):
        return {(r["node_i"], r["node_j"]): round(r["measure"], 5) for r in measure_pairs(panel, measure, Roles()).collect()}

    names = ("spearman_correlation", "kendall_tau", "distance_correlation")
    banded = [values(m) for m in names]
    for m, want in zip(names, banded, strict=True):
        X = np.full((60, 5), np.nan)
        for _, node, d, v in rows:
            X[d, int(node[1])] = v
        sorted_form = {"spearman_correlation": K._sorted_spearman, "kendall_tau": K._sorted_kendall, "distance_correlation": K._sorted_distance_correlation}[m]
        value, _ = K._column_by_column(sorted_form, X, X)
        assert {(f"n{i}", f"n{j}"): round(value[i, j], 5) for i in range(5) for j in range(i + 1, 5)} == want
