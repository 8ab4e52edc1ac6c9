"""NumPy helpers for one tile of a panel; NaN where a series has no value.

Block functions take (dates x a) and (dates x b) and return ``(value, n_obs)``
of shape (a x b).  The others take one series and several, and return arrays of
length m.  Spark decides which series meet in which task; nothing here sees more
than two node blocks.
"""

from __future__ import annotations

import functools
import warnings

import numpy as np

MIN_OBS = 3


def _complete(x, Y):
    mask = ~np.isnan(x)[:, None] & ~np.isnan(Y)
    return mask, mask.sum(axis=0)


def average_ranks(Z):
    """Average ranks down each column; NaN rows sort last and stay NaN."""
    n = Z.shape[0]
    order = np.argsort(np.where(np.isnan(Z), np.inf, Z), axis=0, kind="stable")
    ordered = np.take_along_axis(Z, order, axis=0)
    at = np.arange(n)[:, None]
    opens = np.ones(Z.shape, dtype=bool)
    opens[1:] = ordered[1:] != ordered[:-1]
    closes = np.ones(Z.shape, dtype=bool)
    closes[:-1] = opens[1:]
    first = np.maximum.accumulate(np.where(opens, at, 0), axis=0)
    last = np.minimum.accumulate(np.where(closes, at, n)[::-1], axis=0)[::-1]
    ranks = np.empty(Z.shape)
    np.put_along_axis(ranks, order, (first + last) / 2.0 + 1.0, axis=0)
    return np.where(np.isnan(Z), np.nan, ranks)


def correlation(n, sx, sy, sxy, sxx, syy, min_obs=MIN_OBS, flat=1e-13):
    """``correlation_of_sums`` of the operators, in a tile: NaN when undefined or flat."""
    with np.errstate(all="ignore"):
        vx, vy, cov = n * sxx - sx * sx, n * syy - sy * sy, n * sxy - sx * sy
        tx, ty = flat * n * sxx, flat * n * syy
        defined = (n >= min_obs) & (vx > tx) & (vy > ty)
        if np.isnan(vx.sum() + vy.sum()):  # infinite values; in SQL NaN is larger than any number
            wide = [(v > t) | (np.isnan(v) & ~np.isnan(t)) for v, t in ((vx, tx), (vy, ty))]
            defined = (n >= min_obs) & wide[0] & wide[1]
        cov /= np.sqrt(vx, out=vx)
        cov /= np.sqrt(vy, out=vy)
        return np.where(defined, np.maximum(-1.0, np.fmin(1.0, cov)), np.nan)


# -- whole blocks: (dates x a) against (dates x b) -> (a x b) --------------------------

#: Cells of one working array; bands of dates keep every array below it.
WORK_CELLS = 8_000_000
#: Up to so many dates all pairs of dates are compared; beyond, series are sorted.
BAND_DATES = 400


def _bands(n_dates: int, n_nodes: int):
    rows = max(1, WORK_CELLS // max(1, n_dates * n_nodes))
    for lo in range(0, n_dates, rows):
        yield slice(lo, min(n_dates, lo + rows))


def _masked(X, dtype=np.float64):
    present = ~np.isnan(X)
    return np.where(present, X, 0.0).T, present.T.astype(dtype)


def _against(table, mask):
    """Sum of table[x, s, t] over the dates t of each y: (x, s, y)."""
    n, s, t = table.shape
    return (table.reshape(n * s, t) @ mask.T).reshape(n, s, -1)


def _below(V, M, band):
    """How many dates t are below date s, ties counting half: (x, s, t)."""
    here = V[:, band, None]
    less = (V[:, None, :] < here).astype(np.float32)
    less += 0.5 * (V[:, None, :] == here)
    return less * M[:, None, :]


def _by_length(sorted_form):
    """A block kernel over bands of dates that leaves long series to a form in n log n."""

    def wrap(banded):
        @functools.wraps(banded)
        def kernel(X, Y):
            return banded(X, Y) if len(X) <= BAND_DATES else _column_by_column(sorted_form, X, Y)

        return kernel

    return wrap


def _column_by_column(fn, X, Y):
    """``fn(x, Y) -> (value, n)`` for every column of X, some columns of Y at a time."""
    value, n = (np.empty((X.shape[1], Y.shape[1])) for _ in range(2))
    step = max(1, WORK_CELLS // (8 * len(X)))
    for p in range(X.shape[1]):
        for q in range(0, Y.shape[1], step):
            value[p, q : q + step], n[p, q : q + step] = fn(X[:, p], Y[:, q : q + step])
    return value, n


def _earlier(V, weights):
    """For each row, the sums of the weights of earlier rows whose V is not larger, down each column.

    As merge sort does it: at each width the right half of every block asks
    its sorted left half. All blocks and columns of a width go at once.
    """
    n, m = V.shape
    size = 1 << max(1, (n - 1).bit_length())
    order = np.argsort(V, axis=0, kind="stable")
    ordered = np.take_along_axis(V, order, axis=0)
    step = np.vstack([np.zeros((1, m), bool), ordered[1:] != ordered[:-1]])
    rank = np.full((m, size), n, dtype=np.int64)
    np.put_along_axis(rank[:, :n].T, order, np.cumsum(step, axis=0), axis=0)
    W = [np.zeros((m, size)) for _ in weights]
    for padded, w in zip(W, weights, strict=True):
        padded[:, :n] = w.T
    out = [np.zeros((m, size)) for _ in weights]
    width = 1
    while width < size:
        halves = rank.reshape(-1, 2, width)
        base = np.arange(len(halves))[:, None]
        by = np.argsort(halves[:, 0], axis=1, kind="stable")
        left = np.take_along_axis(halves[:, 0], by, axis=1) + base * (n + 1)
        at = np.searchsorted(left.ravel(), (halves[:, 1] + base * (n + 1)).ravel(), side="right").reshape(-1, width)
        at -= base * width
        for padded, found in zip(W, out, strict=True):
            sums = np.zeros((len(halves), width + 1))
            np.cumsum(np.take_along_axis(padded.reshape(-1, 2, width)[:, 0], by, axis=1), axis=1, out=sums[:, 1:])
            found.reshape(-1, 2, width)[:, 1] += np.take_along_axis(sums, at, axis=1)
        width *= 2
    return [found[:, :n].T for found in out]


def _tied(*sorted_columns):
    """Pairs of equal rows, down each column of what is sorted; NaN is equal to nothing."""
    n, m = sorted_columns[0].shape
    new = np.ones((n, m), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in sorted_columns], axis=0)
    at = np.arange(n)[:, None]
    return (at - np.maximum.accumulate(np.where(new, at, 0), axis=0)).sum(axis=0).astype(float)


def _sorted_spearman(x, Y):
    mask, n = _complete(x, Y)
    rx, ry = average_ranks(np.where(mask, x[:, None], np.nan)), average_ranks(np.where(mask, Y, np.nan))
    middle = (n + 1) / 2.0
    dx, dy = np.where(mask, rx - middle, 0.0), np.where(mask, ry - middle, 0.0)
    xy, xx, yy = (dx * dy).sum(axis=0), (dx * dx).sum(axis=0), (dy * dy).sum(axis=0)
    with np.errstate(all="ignore"):
        r = np.clip(xy / np.sqrt(xx * yy), -1.0, 1.0)
    return np.where((n >= MIN_OBS) & (xx > 0) & (yy > 0), r, np.nan), n


def _sorted_kendall(x, Y):
    """Discordant pairs are inversions of y in the order of x; ties are counted in runs."""
    mask, n = _complete(x, Y)
    A, B = np.where(mask, x[:, None], np.nan), np.where(mask, Y, np.nan)
    by_y = np.argsort(B, axis=0, kind="stable")
    ties_y = _tied(np.take_along_axis(B, by_y, axis=0))
    order = np.take_along_axis(by_y, np.argsort(np.take_along_axis(A, by_y, axis=0), axis=0, kind="stable"), axis=0)
    A, B = np.take_along_axis(A, order, axis=0), np.take_along_axis(B, order, axis=0)
    ties_x, ties_both = _tied(A), _tied(A, B)
    live = ~np.isnan(B)
    (kept,) = _earlier(np.where(live, B, np.inf), [live.astype(float)])
    inverted = np.where(live, np.arange(len(x))[:, None] - kept, 0.0).sum(axis=0)
    size = n.astype(float)
    every = size * (size - 1.0) / 2.0
    free_x, free_y = every - ties_x, every - ties_y
    score = every - ties_x - ties_y + ties_both - 2.0 * inverted
    with np.errstate(all="ignore"):
        tau = np.abs(score) / np.sqrt(free_x * free_y)
    return np.where((n >= MIN_OBS) & (free_x > 0) & (free_y > 0), tau, np.nan), n


def _distance_rows(Z):
    """Each row's summed distance to all rows of its column; Z is zero and sorts last where NaN."""
    live = ~np.isnan(Z)
    order = np.argsort(Z, axis=0, kind="stable")
    ordered = np.where(np.take_along_axis(live, order, axis=0), np.take_along_axis(Z, order, axis=0), 0.0)
    below = np.cumsum(ordered, axis=0)
    total, n = below[-1], live.sum(axis=0)
    at = np.arange(1, len(Z) + 1)[:, None]
    out = np.empty(Z.shape)
    np.put_along_axis(out, order, ordered * (2.0 * at - n) + total - 2.0 * below, axis=0)
    return np.where(live, out, 0.0)


def _sorted_distance_correlation(x, Y):
    """The sum of products of distances from sums over earlier rows with a smaller y, in the order of x."""
    mask, n = _complete(x, Y)

    def scaled(Z):
        with np.errstate(all="ignore"):
            Z = Z - np.nanmean(Z, axis=0)
            top = np.nanmax(np.abs(Z), axis=0)
        return Z / np.where(top > 0, top, 1.0)

    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        A, B = scaled(np.where(mask, x[:, None], np.nan)), scaled(np.where(mask, Y, np.nan))
    order = np.argsort(A, axis=0, kind="stable")
    A, B = np.take_along_axis(A, order, axis=0), np.take_along_axis(B, order, axis=0)
    live = ~np.isnan(A)
    ra, rb = _distance_rows(A), _distance_rows(B)
    a, b = np.where(live, A, 0.0), np.where(live, B, 0.0)
    one = live.astype(float)
    low = _earlier(np.where(live, B, np.inf), [one, a, b, a * b])
    every = [np.cumsum(w, axis=0) - w for w in (one, a, b, a * b)]
    # (a - a')|b - b'| over earlier rows: once with the sign of those below, once with that of those above.
    signed = [2.0 * u - v for u, v in zip(low, every, strict=True)]
    ab = 2.0 * (np.where(live, a * b * signed[0] - b * signed[1] - a * signed[2] + signed[3], 0.0)).sum(axis=0)
    size = n.astype(float)
    aa = 2.0 * (size * (a * a).sum(axis=0) - a.sum(axis=0) ** 2)
    bb = 2.0 * (size * (b * b).sum(axis=0) - b.sum(axis=0) ** 2)
    rab, raa, rbb = (ra * rb).sum(axis=0), (ra * ra).sum(axis=0), (rb * rb).sum(axis=0)
    return _distance_ratio(ab, aa, bb, rab, raa, rbb, ra.sum(axis=0), rb.sum(axis=0), size), n


def _distance_ratio(ab, aa, bb, rab, raa, rbb, ta, tb, n):
    with np.errstate(all="ignore"):
        def dcov(cross, rows, u, v):
            return np.maximum(cross / n**2 - 2.0 * rows / n**3 + u * v / n**4, 0.0)

        scale = np.sqrt(dcov(aa, raa, ta, ta) * dcov(bb, rbb, tb, tb))
        r = np.where(scale > 0, np.sqrt(dcov(ab, rab, ta, tb) / scale), 0.0)
    return np.where(n >= MIN_OBS, np.minimum(r, 1.0), np.nan)


def _leads(V, s):
    """Each row's sign of what it has at date s less what it has at every date; 0 where one is absent."""
    here = V[:, s : s + 1]
    return (V < here).astype(np.float32) - (V > here)


def _tied_cubes(V, others):
    """Over the ties of each row of V within the dates of each of the others: the sum of t^3 - t."""
    order = np.argsort(V, axis=1, kind="stable")
    ordered = np.take_along_axis(V, order, axis=1)
    again = np.zeros(V.shape, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    if not again.any():
        return 0.0
    tied = again.copy()
    tied[:, :-1] |= again[:, 1:]
    opens = tied & ~again
    row, at = np.nonzero(tied)
    owner = np.nonzero(opens)[0]
    groups = np.zeros((len(owner), V.shape[1]), np.float32)
    groups[np.cumsum(opens[row, at]) - 1, order[row, at]] = 1.0
    out = np.zeros((len(V), len(others)))
    step = max(1, WORK_CELLS // (8 * len(others)))
    for lo in range(0, len(owner), step):
        t = (groups[lo : lo + step] @ others.T).astype(np.float64)
        own = owner[lo : lo + step]
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[starts]] += np.add.reduceat(t * t * t - t, starts, axis=0)
    return out


#: Up to so many dates single precision holds every sum of products of ranks exactly.
SINGLE_DATES = 256


@_by_length(_sorted_spearman)
def spearman(X, Y):
    """Average ranks within each pair's own dates, as signs against the dates of both.

    The signs of a value against the others add up to twice its rank less the
    mean rank. Squares of ranks follow from the number of dates and the ties.
    """
    A, B = np.ascontiguousarray(X.T), np.ascontiguousarray(Y.T)
    MA, MB = (~np.isnan(A)).astype(np.float32), (~np.isnan(B)).astype(np.float32)
    n = (MA @ MB.T).astype(np.float64)
    xy = np.zeros(n.shape, np.float32 if len(X) <= SINGLE_DATES else np.float64)
    rx, ry = np.empty(n.shape, np.float32), np.empty(n.shape, np.float32)
    for s in range(len(X)):
        np.matmul(_leads(A, s), MB.T, out=rx)
        np.matmul(MA, _leads(B, s).T, out=ry)
        rx *= ry
        xy += rx
    every = n * n * n - n
    xx, yy = (every - _tied_cubes(A, MB)) / 3.0, (every - np.transpose(_tied_cubes(B, MA))) / 3.0
    with np.errstate(all="ignore"):
        r = np.clip(xy / np.sqrt(xx * yy), -1.0, 1.0)
    return np.where((n >= MIN_OBS) & (xx > 0) & (yy > 0), r, np.nan), n


@_by_length(_sorted_kendall)
def kendall(X, Y):
    """Absolute tau-b: sign products over date pairs, a band of dates at a time."""
    (A, MA), (B, MB) = _masked(X, np.float32), _masked(Y, np.float32)
    n = (MA @ MB.T).astype(np.float64)
    score, free_x, free_y = np.zeros(n.shape), np.zeros(n.shape), np.zeros(n.shape)

    def signs(V, M, band):
        later = np.arange(V.shape[1])[None, :] > np.arange(V.shape[1])[band, None]
        pair = (M[:, band, None] * M[:, None, :]) * later
        s = np.sign(V[:, None, :] - V[:, band, None]).astype(np.float32) * pair
        return s.reshape(len(V), -1), pair.reshape(len(V), -1)

    for band in _bands(len(X), max(n.shape)):
        sx, px = signs(A, MA, band)
        sy, py = signs(B, MB, band)
        score += sx @ sy.T
        free_x += np.abs(sx) @ py.T
        free_y += px @ np.abs(sy).T
    with np.errstate(all="ignore"):
        tau = np.abs(score) / np.sqrt(free_x * free_y)
    return np.where((n >= MIN_OBS) & (free_x > 0) & (free_y > 0), tau, np.nan), n


@_by_length(_sorted_distance_correlation)
def distance_correlation(X, Y):
    """Every term of the distance covariances is a sum over dates of a pair."""

    def scaled(Z):
        with np.errstate(all="ignore"):
            Z = Z - np.nanmean(Z, axis=0)
            top = np.nanmax(np.abs(Z), axis=0)
        return Z / np.where(top > 0, top, 1.0)

    (A, MA), (B, MB) = _masked(scaled(X)), _masked(scaled(Y))
    n = MA @ MB.T
    sums = np.zeros((8, *n.shape))
    for band in _bands(len(X), max(n.shape)):
        da = np.abs(A[:, band, None] - A[:, None, :]) * MA[:, band, None] * MA[:, None, :]
        db = np.abs(B[:, band, None] - B[:, None, :]) * MB[:, band, None] * MB[:, None, :]
        flat_a, flat_b = da.reshape(len(da), -1), db.reshape(len(db), -1)
        pa = (MA[:, band, None] * MA[:, None, :]).reshape(len(da), -1)
        pb = (MB[:, band, None] * MB[:, None, :]).reshape(len(db), -1)
        both = MA[:, band, None] * MB[:, band].T[None]
        ra = _against(da, MB) * both
        rb = _against(db, MA).transpose(2, 1, 0) * both
        sums += (
            flat_a @ flat_b.T, (flat_a * flat_a) @ pb.T, pa @ (flat_b * flat_b).T,
            (ra * rb).sum(axis=1), (ra * ra).sum(axis=1), (rb * rb).sum(axis=1),
            ra.sum(axis=1), rb.sum(axis=1),
        )
    ab, aa, bb, rab, raa, rbb, ta, tb = sums
    return _distance_ratio(ab, aa, bb, rab, raa, rbb, ta, tb, n), n


# -- one series against several -----------------------------------------------------


def chatterjee_xi(x, Y):
    """x is the earlier node of the pair; tied x keep date order."""
    mask, n = _complete(x, Y)
    ranks = average_ranks(np.where(mask, Y, np.nan))
    order = np.argsort(x, kind="stable")
    ranks, live = ranks[order], mask[order]
    at = np.where(live, np.arange(len(x))[:, None], -1)
    before = np.vstack([np.full((1, Y.shape[1]), -1), np.maximum.accumulate(at, axis=0)[:-1]])
    step = np.abs(ranks - np.take_along_axis(ranks, np.maximum(before, 0), axis=0))
    total = np.where(live & (before >= 0), step, 0.0).sum(axis=0)
    size = n.astype(float)
    with np.errstate(all="ignore"):
        xi = np.abs(1.0 - 3.0 * total / (size * size - 1.0))
    return np.where(n >= MIN_OBS, xi, np.nan), n


def _kth_gap(a, b, k, band=512):
    """Chebyshev distance to the k-th nearest other point, in bands of rows."""
    n = len(a)
    out = np.empty(n)
    for lo in range(0, n, band):
        d = np.maximum(
            np.abs(a[lo : lo + band, None] - a[None, :]),
            np.abs(b[lo : lo + band, None] - b[None, :]),
        )
        rows = np.arange(d.shape[0])
        d[rows, lo + rows] = np.inf
        out[lo : lo + band] = np.partition(d, k - 1, axis=1)[:, k - 1]
    return out


def _within(v, radius):
    """How many other values lie within each value's radius, by their differences."""
    s, n = np.sort(v), len(v)
    low, high = np.searchsorted(s, v - radius, side="left"), np.searchsorted(s, v + radius, side="right")
    # Value and radius are rounded when they are added, so that the ends may be off.
    while True:
        wide = ((high < n) & (s[np.minimum(high, n - 1)] - v <= radius)).astype(int) - (s[np.maximum(high - 1, 0)] - v > radius)
        early = (v - s[np.minimum(low, n - 1)] > radius).astype(int) - ((low > 0) & (v - s[np.maximum(low - 1, 0)] <= radius))
        if not (wide.any() or early.any()):
            return high - low - 1
        high, low = high + wide, low + early


def mutual_information(x, Y, k=3):
    """Nearest-neighbour mutual information in nats, before normalisation."""
    mask, n = _complete(x, Y)
    out = np.full(Y.shape[1], np.nan)
    for q in np.flatnonzero(n > k):
        rows = mask[:, q]
        a, b = x[rows], Y[rows, q]
        a = a / (a.std() or 1.0)
        b = b / (b.std() or 1.0)
        m = len(a)
        radius = np.nextafter(_kth_gap(a, b, k), 0)
        harmonic = np.concatenate([[0.0], np.cumsum(1.0 / np.arange(1, m + 1))])
        # digamma(j) = harmonic(j - 1) - gamma; the gammas cancel here.
        na, nb = _within(a, radius), _within(b, radius)
        value = (
            harmonic[m - 1]
            + harmonic[k - 1]
            - harmonic[na].mean()
            - harmonic[nb].mean()
        )
        out[q] = max(0.0, value)
    return out, n


def _warp(x, B, band):
    """Warping distance of x to each column of B, one anti-diagonal at a time."""
    n, m = len(x), B.shape[0]
    width = B.shape[1]
    before = np.full((n + 1, width), np.inf)
    last = np.full((n + 1, width), np.inf)
    last[0] = 0.0
    for s in range(2, n + m + 1):
        lo, hi = max(1, s - m), min(n, s - 1)
        if band is not None:
            lo, hi = max(lo, -(-(s - band) // 2)), min(hi, (s + band) // 2)
        now = np.full((n + 1, width), np.inf)
        if lo <= hi:
            i = np.arange(lo, hi + 1)
            cost = np.abs(x[i - 1][:, None] - B[s - i - 1])
            # before is diagonal s-2, last is s-1; row index is i.
            if s == 2:
                best = last[i - 1]
            else:
                best = np.minimum(np.minimum(last[i - 1], last[i]), before[i - 1])
            now[i] = cost + best
        if s == 2:
            last = np.full((n + 1, width), np.inf)
        before, last = last, now
    return last[n]


def warping_distance(x, Y, radius=None):
    """Each series drops its own gaps; a banded pair longer apart is undefined."""
    a = x[~np.isnan(x)]
    present = ~np.isnan(Y)
    n = present.sum(axis=0)
    out = np.full(Y.shape[1], np.nan)
    if len(a) >= MIN_OBS:
        for size in np.unique(n[n >= MIN_OBS]):
            if radius is not None and abs(int(size) - len(a)) > radius:
                continue
            cols = np.flatnonzero(n == size)
            B = np.column_stack([Y[present[:, q], q] for q in cols])
            out[cols] = _warp(a, B, radius)
    return out, np.minimum(n, len(a))


def maximal_correlation(x, Y, max_bins=8):
    """Second singular value of the equal-frequency contingency table."""
    mask, n = _complete(x, Y)
    out = np.full(Y.shape[1], np.nan)
    for q in np.flatnonzero(n >= MIN_OBS):
        rows = mask[:, q]
        m = int(n[q])
        bins = int(max(2, min(max_bins, np.sqrt(m / 5.0))))
        pair = average_ranks(np.column_stack([x[rows], Y[rows, q]]))
        if np.ptp(pair[:, 0]) == 0 or np.ptp(pair[:, 1]) == 0:
            continue
        cell = np.minimum(((pair - 0.5) * bins / m).astype(int), bins - 1)
        counts = np.zeros((bins, bins))
        np.add.at(counts, (cell[:, 0], cell[:, 1]), 1.0)
        counts /= m
        px, py = counts.sum(axis=1), counts.sum(axis=0)
        counts, px = counts[px > 0], px[px > 0]
        counts, py = counts[:, py > 0], py[py > 0]
        if min(counts.shape) < 2:
            continue
        Q = (counts - np.outer(px, py)) / np.sqrt(np.outer(px, py))
        out[q] = min(1.0, float(np.linalg.svd(Q, compute_uv=False)[0]))
    return out, n
