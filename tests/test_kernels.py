"""Tile numerics against direct definitions."""

from __future__ import annotations

import numpy as np
import pytest

from stratanet.functions.tails import chi2_tail_series
from stratanet.operators import kernels as K
from stratanet.operators.communities import assign, cluster_scores, embed, kmeans


@pytest.fixture
def block():
    rng = np.random.default_rng(3)
    X = np.round(rng.normal(size=(25, 4)), 1)
    Y = np.round(rng.normal(size=(25, 5)), 1)
    X[rng.random(X.shape) < 0.2] = np.nan
    Y[rng.random(Y.shape) < 0.2] = np.nan
    return X, Y


def pairs(block):
    X, Y = block
    for p in range(X.shape[1]):
        for q in range(Y.shape[1]):
            ok = ~np.isnan(X[:, p]) & ~np.isnan(Y[:, q])
            yield p, q, X[ok, p], Y[ok, q]


def ranks(v):
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_spearman_ranks_inside_the_pair(block):
    value, n = K.spearman(*block)
    for p, q, x, y in pairs(block):
        assert n[p, q] == len(x)
        assert value[p, q] == pytest.approx(np.corrcoef(ranks(x), ranks(y))[0, 1], abs=1e-6)


def test_kendall_tau_b(block):
    value, _ = K.kendall(*block)
    for p, q, x, y in pairs(block):
        sx, sy = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
        want = abs((sx * sy).sum()) / np.sqrt((sx**2).sum() * (sy**2).sum())
        assert value[p, q] == pytest.approx(want, abs=1e-9)


def test_distance_correlation(block):
    def centred(v):
        d = np.abs(v[:, None] - v)
        return d - d.mean(0) - d.mean(1)[:, None] + d.mean()

    value, _ = K.distance_correlation(*block)
    for p, q, x, y in pairs(block):
        a, b = centred(x), centred(y)
        want = np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean()))
        assert value[p, q] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("fn", [K.spearman, K.kendall, K.distance_correlation])
def test_bands_do_not_change_results(block, fn, monkeypatch):
    whole, _ = fn(*block)
    monkeypatch.setattr(K, "WORK_CELLS", 300)
    banded, _ = fn(*block)
    np.testing.assert_allclose(whole, banded, atol=1e-6)


def test_xi_uses_the_first_argument_as_order(block):
    X, Y = block
    for p in range(X.shape[1]):
        value, _ = K.chatterjee_xi(X[:, p], Y)
        for q in range(Y.shape[1]):
            ok = ~np.isnan(X[:, p]) & ~np.isnan(Y[:, q])
            x, r = X[ok, p], ranks(Y[ok, q])
            d = np.abs(np.diff(r[np.argsort(x, kind="stable")])).sum()
            assert value[q] == pytest.approx(abs(1 - 3 * d / (len(x) ** 2 - 1)))


@pytest.mark.parametrize("radius", [None, 2])
def test_warping(block, radius):
    X, Y = block
    x = X[:, 0]
    value, _ = K.warping_distance(x, Y, radius)
    a = x[~np.isnan(x)]
    for q in range(Y.shape[1]):
        b = Y[~np.isnan(Y[:, q]), q]
        D = np.full((len(a) + 1, len(b) + 1), np.inf)
        D[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                if radius is None or abs(i - j) <= radius:
                    D[i, j] = abs(a[i - 1] - b[j - 1]) + min(D[i - 1, j], D[i, j - 1], D[i - 1, j - 1])
        if np.isinf(D[-1, -1]):
            assert np.isnan(value[q])
        else:
            assert value[q] == pytest.approx(D[-1, -1])


def test_information_of_a_copy_exceeds_that_of_noise():
    rng = np.random.default_rng(0)
    x = rng.normal(size=200)
    value, _ = K.mutual_information(x, np.column_stack([x, x**2, rng.normal(size=200)]))
    assert value[0] > value[1] > value[2] >= 0


def test_maximal_correlation_sees_a_parabola():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    value, _ = K.maximal_correlation(x, np.column_stack([x**2, rng.normal(size=500)]))
    assert value[0] > 0.7 and value[1] < 0.3


def test_few_observations_are_undefined():
    x = np.array([1.0, 2.0, np.nan, np.nan])
    Y = np.array([[1.0], [3.0], [2.0], [5.0]])
    for fn in (K.spearman, K.kendall, K.distance_correlation):
        value, n = fn(x[:, None], Y)
        assert np.isnan(value[0, 0]) and n[0, 0] == 2
    assert np.isnan(K.chatterjee_xi(x, Y)[0][0])


def test_chi_square_tail_known_values():
    # Upper 5 % points of the chi-square distribution.
    for df, point in ((1, 3.841459), (2, 5.991465), (5, 11.070498), (8, 15.507313)):
        assert chi2_tail_series(np.array([point]), df)[0] == pytest.approx(0.05, abs=1e-6)


def test_assignment_is_least_cost():
    from itertools import permutations

    rng = np.random.default_rng(1)
    for shape in ((4, 4), (3, 5), (5, 3)):
        C = rng.random(shape)
        got = sum(C[r, c] for r, c in assign(C))
        S = C if shape[0] <= shape[1] else C.T
        want = min(
            sum(S[i, p[i]] for i in range(S.shape[0]))
            for p in permutations(range(S.shape[1]), S.shape[0])
        )
        assert got == pytest.approx(want)


def test_planted_partition_is_found():
    A = np.zeros((12, 12))
    A[:6, :6] = A[6:, 6:] = 1
    np.fill_diagonal(A, 0)
    A[5, 6] = A[6, 5] = 1
    labels, _ = kmeans(embed(A, 2), 2)
    assert len(set(labels[:6])) == len(set(labels[6:])) == 1 and labels[0] != labels[11]
    score = cluster_scores(A, embed(A, 2), labels)
    assert score["silhouette"] > 0.5 and score["modularity"] > 0.4
