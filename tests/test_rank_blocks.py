"""Spearman of blocks: ranks of a pair's own dates without an array of blocks by dates."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from stratanet.operators import kernels as K


def ranked(x, y):
    """Spearman by sorting the common dates of one pair."""
    both = ~np.isnan(x) & ~np.isnan(y)
    if both.sum() < 3:
        return np.nan
    r = [(v[:, None] > v[None, :]).sum(axis=1) + ((v[:, None] == v[None, :]).sum(axis=1) + 1) / 2.0 for v in (x[both], y[both])]
    return np.nan if min(np.ptp(r[0]), np.ptp(r[1])) == 0 else np.corrcoef(*r)[0, 1]


@pytest.mark.parametrize("kind", ["free", "few values", "two values", "flat"])
@pytest.mark.parametrize("dates", [3, 30, 300])
def test_ties_and_gaps_count_within_the_pair(kind, dates):
    rng = np.random.default_rng(dates)
    X, Y = rng.normal(size=(dates, 9)), rng.normal(size=(dates, 7))
    for Z in (X, Y):
        if kind != "free":
            Z[:] = np.round(Z) if kind == "few values" else Z > 0
        if kind == "flat":
            Z[:, ::2] = 4.0
        Z[rng.random(Z.shape) > 0.7] = np.nan
    value, n = K.spearman(X, Y)
    want = np.array([[ranked(x, y) for y in Y.T] for x in X.T])
    assert np.array_equal(n, (~np.isnan(X)).T.astype(int) @ ~np.isnan(Y))
    np.testing.assert_allclose(value, want, atol=1e-12)


def test_memory_does_not_grow_with_the_dates():
    rng = np.random.default_rng(1)
    X = rng.normal(size=(90, 128))
    X[rng.random(X.shape) > 0.9] = np.nan
    tracemalloc.start()
    K.spearman(X, X)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * 128 * 128 * 8
