"""Spectral communities of graphs that no task could hold: embedding, k-means and scores over node rows.

A node is a row with its vector; whatever grows with a graph stays in such
rows. Outside of them there are matrices of d × d (embedding) and k × d
(centres) only, which are summed per task and once more per graph. Graphs go
in lots whose small matrices together fit ``LOT_CELLS``, and all graphs of a
lot share their jobs.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratanet.session import dropped, written

#: Doubles of the small matrices of a lot of graphs.
LOT_CELLS = 16 << 20
#: Directions beyond those asked for, and blocks of a Krylov space.
OVERSAMPLE, BLOCKS = 8, 3
#: Restarts of the embedding at most, and the residual, against the largest value, at which it ends.
RESTARTS, TOLERANCE = 60, 1e-5
#: Rounds of candidate centres, candidates a round and cluster.
SEED_ROUNDS, SEEDS = 4, 4
#: Starts that are tried on the candidates for each restart, and those that are followed over all points.
TRIES, STARTS = 4, 4
#: Rounds of Lloyd at most.
ROUNDS = 300
#: Points of a block; a tile measures the distances of two blocks.
BLOCK = 2048
#: Points of a group of blocks at most, and groups of a graph at least, as far as it has blocks.
GROUP_POINTS, GROUPS = 32_768, 6

Matrices = dict[int, np.ndarray]


# -- arrays of rows ------------------------------------------------------------------


def matrix(column: pa.Array, rows: np.ndarray | None = None) -> np.ndarray:
    """Rows of equal length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column if rows is None else column.take(pa.array(rows))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def lists(X: np.ndarray) -> pa.Array:
    """The rows of a matrix."""
    ends = np.arange(len(X) + 1, dtype="int32") * X.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(X, dtype="float64").ravel()))


def by_graph(batch) -> Iterator[tuple[int, np.ndarray]]:
    """(graph, its rows) of a batch."""
    g = batch.column("g").to_numpy()
    for value in np.unique(g):
        yield int(value), np.flatnonzero(g == value)


def runs(batches, names: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted batches as tables in which no run of equal ``names`` is cut."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        new = np.zeros(table.num_rows, bool)
        for name in names:
            values = table.column(name).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None:
        yield rest


def totals(rows: DataFrame, fn: Callable[[int, object, np.ndarray], np.ndarray]) -> Matrices:
    """The sum over all rows of a graph of ``fn(graph, batch, its rows)``: per task, then per graph."""

    def part(batches):
        held: Matrices = {}
        for batch in batches:
            for g, own in by_graph(batch):
                value = fn(g, batch, own)
                held[g] = held[g] + value if g in held else value
        yield _vectors(held)

    def merge(batches):
        held: Matrices = {}
        for batch in batches:
            for g, own in by_graph(batch):
                value = matrix(batch.column("v"), own).sum(axis=0)
                held[g] = held[g] + value if g in held else value
        yield _vectors(held)

    schema = "g int, v array<double>"
    return {
        r.g: np.array(r.v)
        for r in rows.mapInArrow(part, schema).repartition("g").mapInArrow(merge, schema).toLocalIterator()
    }


def _vectors(held: Matrices) -> pa.RecordBatch:
    ends = np.cumsum([0, *(v.size for v in held.values())]).astype("int32")
    flat = np.concatenate([v.ravel() for v in held.values()]) if held else np.zeros(0)
    return pa.record_batch(
        [pa.array(list(held), pa.int32()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.float64()))],
        names=["g", "v"],
    )


# -- embedding -----------------------------------------------------------------------


def start_vectors(nodes: DataFrame) -> DataFrame:
    """(g, id, p, vec): numbers that depend on the node alone."""
    number = F.transform(
        F.sequence(F.lit(1), F.col("p")),
        lambda j: F.pmod(F.xxhash64("node", j), F.lit(1 << 40)).cast("double") / float(1 << 40) - 0.5,
    )
    return nodes.select("g", "id", "p", number.alias("vec"))


def _partial(batches):
    for batch in batches:
        for g, own in by_graph(batch):
            V = matrix(batch.column("vec"), own) * batch.column("w").to_numpy()[own, None]
            ids = batch.column("id").to_numpy()[own]
            by = np.argsort(ids, kind="stable")
            names, first = np.unique(ids[by], return_index=True)
            yield pa.record_batch(
                [pa.array(np.full(len(names), g, "int32")), pa.array(names), lists(np.add.reduceat(V[by], first, axis=0))],
                names=["g", "id", "vec"],
            )


def _merged(batches):
    """Each node's own vector with the sum of what its neighbours gave behind it."""
    for table in runs(batches, ("g", "id")):
        for g, rows in by_graph(table):
            own = table.column("own").to_numpy(zero_copy_only=False)[rows]
            ids = table.column("id").to_numpy()[rows]
            mine, given = rows[own], rows[~own]
            left = matrix(table.column("vec"), mine)
            given = given[np.argsort(ids[~own], kind="stable")]
            names, first = np.unique(np.sort(ids[~own]), return_index=True)
            right = np.add.reduceat(matrix(table.column("vec"), given), first, axis=0)
            at = np.searchsorted(names, ids[own])
            yield pa.record_batch(
                [pa.array(np.full(len(mine), g, "int32")), pa.array(ids[own]), table.column("p").combine_chunks().take(pa.array(mine)),
                 lists(np.hstack([left, right[at]]))],
                names=["g", "id", "p", "vec"],
            )


def applied(points: DataFrame, edges: DataFrame) -> DataFrame:
    """The vectors with B times their last p columns behind them.

    ``edges`` (g, src, dst, w) holds both directions and the diagonal. What
    meets in a node is summed within each batch first, so that a hub gets a
    row from each task, not from each edge.
    """
    last = points.select("g", F.col("id").alias("dst"), F.expr("slice(vec, size(vec) - p + 1, p)").alias("vec"))
    given = edges.join(last, ["g", "dst"]).select("g", F.col("src").alias("id"), "w", "vec")
    given = given.mapInArrow(_partial, "g int, id long, vec array<double>").withColumn("own", F.lit(False)).withColumn("p", F.lit(0))
    rows = points.withColumn("own", F.lit(True)).unionByName(given)
    rows = rows.repartition("g", "id").sortWithinPartitions("g", "id")
    return rows.mapInArrow(_merged, "g int, id long, p int, vec array<double>")


def ritz(H: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(combination, values, residuals) of the best p directions in the span of all blocks but the last.

    H holds the products of all columns [X, BX, B²X …] with each other.
    """
    s = len(H) - p
    G, T = H[:s, :s], H[:s, p:]
    scale = 1.0 / np.sqrt(np.maximum(np.diag(G), 1e-300))
    values, U = np.linalg.eigh(G * scale[:, None] * scale)
    keep = values > 1e-11 * values[-1]
    Q = scale[:, None] * U[:, keep] / np.sqrt(values[keep])
    M = Q.T @ T @ Q
    theta, Z = np.linalg.eigh((M + M.T) / 2)
    top = np.argsort(-np.abs(theta), kind="stable")[:p]
    C, theta = Q @ Z[:, top], theta[top]
    if len(top) < p:
        C, theta = np.pad(C, ((0, 0), (0, p - len(top)))), np.pad(theta, (0, p - len(top)))
    length = np.einsum("ij,ij->j", C, H[p:, p:] @ C)
    return C, theta, np.sqrt(np.maximum(length - theta**2, 0.0))


def _rotated(sent):
    def run(batches):
        for batch in batches:
            for g, own in by_graph(batch):
                C = sent.value[g]
                X = matrix(batch.column("vec"), own)[:, : len(C)] @ C
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(own)), batch.column(1).take(pa.array(own)), pa.array(np.full(len(own), C.shape[1], "int32")), lists(X)],
                    names=["g", "id", "p", "vec"],
                )

    return run


def embedding(nodes: DataFrame, edges: DataFrame, sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """(g, id, p, vec): the d directions of largest absolute eigenvalue, scaled by its root.

    ``sizes`` gives (p, d) of every graph. A restarted block Krylov space: each
    round takes the best p directions in the span of X, BX, B²X, until the
    residuals of all d are small.
    """
    context = nodes.sparkSession.sparkContext
    points = written(start_vectors(nodes), "spectral-start")
    for turn in range(RESTARTS):
        spread = points
        for _ in range(BLOCKS):
            following = written(applied(spread, edges), "spectral-powers")
            if spread is not points:
                dropped(spread)
            spread = following
        products = totals(spread.select("g", "vec"), _gram)
        found = {g: ritz(v.reshape(int(v.size**0.5), -1), sizes[g][0]) for g, v in products.items()}
        done = turn == RESTARTS - 1 or all(
            (bad[: sizes[g][1]] <= TOLERANCE * max(np.abs(theta).max(), 1e-300)).all() for g, (_, theta, bad) in found.items()
        )
        factors = {g: C for g, (C, _, _) in found.items()}
        if done:
            factors = {g: (C * np.sqrt(np.abs(theta)))[:, : sizes[g][1]] for g, (C, theta, _) in found.items()}
        sent = context.broadcast(factors)
        following = written(spread.mapInArrow(_rotated(sent), "g int, id long, p int, vec array<double>"), "spectral-points")
        sent.destroy()
        dropped(points, spread)
        points = following
        if done:
            return points


def _gram(g, batch, own):
    X = matrix(batch.column("vec"), own)
    return (X.T @ X).ravel()


# -- k-means -------------------------------------------------------------------------


def squared(X: np.ndarray, centres: np.ndarray) -> np.ndarray:
    gap = (X**2).sum(axis=1)[:, None] - 2.0 * X @ centres.T + (centres**2).sum(axis=1)
    return np.maximum(gap, 0.0)


def draw(hashes: np.ndarray, turn: int) -> np.ndarray:
    """A number in [0, 1) for each node and round."""
    x = hashes.astype("uint64") + np.uint64((turn + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype("float64") / float(1 << 53)


def candidates(points: DataFrame, most: int) -> tuple[Matrices, Matrices]:
    """Points far from each other, and how many points are nearest to each, per graph.

    In every round a point is taken with a probability that grows with its
    squared distance to those taken before.
    """
    context = points.sparkSession.sparkContext
    first = points.groupBy("g").agg(F.min_by("vec", F.struct("hash", "id")).alias("vec"))
    taken = {r.g: np.array([r.vec]) for r in first.collect()}  # a row for each graph of a lot
    for turn in range(SEED_ROUNDS):
        sent = context.broadcast(taken)
        gaps = totals(points, lambda g, b, own: squared(matrix(b.column("vec"), own), sent.value[g]).min(axis=1).sum(keepdims=True))

        def pick(batches, sent=sent, gaps=gaps, turn=turn):
            for batch in batches:
                for g, own in by_graph(batch):
                    gap = squared(matrix(batch.column("vec"), own), sent.value[g]).min(axis=1)
                    chance = SEEDS * most * gap / gaps[g][0] if gaps[g][0] > 0 else np.zeros(len(gap))
                    rows = own[draw(batch.column("hash").to_numpy()[own], turn) < chance]
                    yield pa.record_batch([pa.array(np.full(len(rows), g, "int32")), batch.column("id").take(pa.array(rows)), batch.column("vec").take(pa.array(rows))], names=["g", "id", "vec"])

        # About SEEDS candidates for each cluster are expected.
        new = points.mapInArrow(pick, "g int, id long, vec array<double>").orderBy("g", "id").collect()
        for r in new:
            taken[r.g] = np.vstack([taken[r.g], r.vec])
        sent.destroy()
    sent = context.broadcast(taken)

    def nearest(g, batch, own):
        label = squared(matrix(batch.column("vec"), own), sent.value[g]).argmin(axis=1)
        return np.bincount(label, minlength=len(sent.value[g])).astype("float64")

    weights = totals(points, nearest)
    sent.destroy()
    return taken, weights


def weighted_kmeans(X: np.ndarray, weight: np.ndarray, k: int, rng) -> tuple[float, np.ndarray]:
    """(inertia, centres) of one seeded run over weighted points."""
    centres = X[[rng.choice(len(X), p=weight / weight.sum())]]
    while len(centres) < k:
        chance = weight * squared(X, centres).min(axis=1)
        pick = rng.choice(len(X), p=chance / chance.sum()) if chance.sum() > 0 else rng.integers(len(X))
        centres = np.vstack([centres, X[pick]])
    for _ in range(ROUNDS):
        label = squared(X, centres).argmin(axis=1)
        Z = np.eye(k)[label] * weight[:, None]
        size = Z.sum(axis=0)
        new = np.where(size[:, None] > 0, (Z.T @ X) / np.maximum(size, 1e-300)[:, None], centres)
        if np.array_equal(new, centres):
            break
        centres = new
    return float((weight * squared(X, centres).min(axis=1)).sum()), centres


@dataclasses.dataclass
class Clusters:
    """One set of centres and what its last pass has counted: sizes, sums, distances and their squares."""

    k: int
    centres: np.ndarray
    size: np.ndarray | None = None
    apart: np.ndarray | None = None
    inertia: float = np.inf
    settled: bool = False


def followed(points: DataFrame, sets: dict[int, list[Clusters]], rounds: int = ROUNDS) -> None:
    """Moves the centres of all sets to the means of their points until none moves; all sets share each pass."""
    context = points.sparkSession.sparkContext
    for _ in range(rounds):
        open_sets = {g: [c for c in of if not c.settled] for g, of in sets.items()}
        open_sets = {g: of for g, of in open_sets.items() if of}
        if not open_sets:
            return
        sent = context.broadcast({g: [c.centres for c in of] for g, of in open_sets.items()})

        def count(g, batch, own, sent=sent):
            if g not in sent.value:
                return np.zeros(0)
            X = matrix(batch.column("vec"), own)
            out = []
            for centres in sent.value[g]:
                gap = squared(X, centres)
                label = gap.argmin(axis=1)
                least = gap[np.arange(len(X)), label]
                Z = np.eye(len(centres))[label]
                out += [Z.sum(axis=0), Z.T @ np.sqrt(least), Z.T @ least, (Z.T @ X).ravel()]
            return np.concatenate(out)

        counted = totals(points, count)
        sent.destroy()
        for g, of in open_sets.items():
            rest = counted[g]
            for c in of:
                parts = np.split(rest, np.cumsum([c.k, c.k, c.k, c.centres.size]))
                size, apart, square, sums, rest = parts
                means = np.where(size[:, None] > 0, sums.reshape(c.k, -1) / np.maximum(size, 1)[:, None], c.centres)
                c.settled = bool(np.abs(means - c.centres).max() <= 1e-12 * max(1.0, np.abs(means).max()))
                c.size, c.apart, c.inertia = size, apart / np.maximum(size, 1), float(square.sum())
                c.centres = means


def kmeans(points: DataFrame, ks: dict[int, list[int]], restarts: int) -> dict[int, dict[int, Clusters]]:
    """The best clustering of every graph for each k asked of it.

    Seeded starts are tried on the candidates; the best few of each k are
    followed over all points.
    """
    taken, weights = candidates(points, max(max(of) for of in ks.values()))
    sets: dict[int, list[Clusters]] = {}
    for g, of in ks.items():
        for k in of:
            rng = np.random.default_rng(0)
            tried = sorted((weighted_kmeans(taken[g], weights[g], k, rng) for _ in range(TRIES * restarts)), key=lambda t: t[0])
            sets.setdefault(g, []).extend(Clusters(k, centres) for _, centres in tried[:STARTS])
    followed(points, sets)
    return {g: {k: min((c for c in of if c.k == k), key=lambda c: c.inertia) for k in ks[g]} for g, of in sets.items()}


def labelled(points: DataFrame, best: dict[int, dict[int, Clusters]]) -> DataFrame:
    """(g, id, vec, labels): the cluster of every point for each k, in ascending order of k."""
    sent = points.sparkSession.sparkContext.broadcast({g: [of[k].centres for k in sorted(of)] for g, of in best.items()})

    def run(batches):
        for batch in batches:
            for g, own in by_graph(batch):
                X = matrix(batch.column("vec"), own)
                labels = np.array([squared(X, c).argmin(axis=1) for c in sent.value[g]], dtype="int32").T
                ends = np.arange(len(own) + 1, dtype="int32") * labels.shape[1]
                rows = pa.array(own)
                yield pa.record_batch(
                    [*(batch.column(c).take(rows) for c in ("g", "id", "vec")), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(labels).ravel()))],
                    names=["g", "id", "vec", "labels"],
                )

    return points.mapInArrow(run, "g int, id long, vec array<double>, labels array<int>")


# -- scores --------------------------------------------------------------------------


def measured(points: DataFrame, ks: dict[int, list[int]]) -> dict[int, list[Clusters]]:
    """Sizes, means and distances to them of given clusterings: ``points`` (g, id, vec, labels)."""

    def sums(g, batch, own):
        X, Z = matrix(batch.column("vec"), own), one_hot(matrix(batch.column("labels"), own), ks[g])
        return np.hstack([Z.sum(axis=0)[:, None], Z.T @ X]).ravel()

    out: dict[int, list[Clusters]] = {}
    for g, v in totals(points, sums).items():
        table, at = v.reshape(sum(ks[g]), -1), 0
        for k in ks[g]:
            size, total = table[at : at + k, 0], table[at : at + k, 1:]
            out.setdefault(g, []).append(Clusters(k, total / np.maximum(size, 1)[:, None], size))
            at += k
    sent = points.sparkSession.sparkContext.broadcast({g: [c.centres for c in of] for g, of in out.items()})

    def distances(g, batch, own):
        X, labels = matrix(batch.column("vec"), own), matrix(batch.column("labels"), own)
        parts = []
        for c, centres in enumerate(sent.value[g]):
            square = ((X - centres[labels[:, c]]) ** 2).sum(axis=1)
            parts += [np.bincount(labels[:, c], np.sqrt(square), len(centres)), square.sum(keepdims=True)]
        return np.concatenate(parts)

    for g, v in totals(points, distances).items():
        for c in out[g]:
            c.apart, c.inertia, v = v[: c.k] / np.maximum(c.size, 1), float(v[c.k]), v[c.k + 1 :]
    sent.destroy()
    return out


def partition_scores(points: DataFrame, pairs: DataFrame, ks: dict[int, list[int]], block: int = BLOCK) -> list[tuple]:
    """(g, k, clusters found, inertia, scores) of given clusterings.

    ``points`` (g, id, vec, labels) has a label below k for each k of the
    graph, ``pairs`` (g, src, dst) the graph's edges in both directions.
    """
    found = measured(points, ks)
    outline = silhouettes(points, ks, {g: [c.size for c in of] for g, of in found.items()}, block)
    cut = modularities(points, pairs, ks)
    rows = []
    for g, of in sorted(found.items()):
        for at, c in enumerate(of):
            n_found = int((c.size > 0).sum())
            score = {
                "silhouette": outline[g][at], "modularity": cut[g][at] if n_found >= 2 else np.nan,
                **centre_scores(c, int(c.size.sum())),
            }
            rows.append((g, c.k, n_found, c.inertia, {name: float(v) for name, v in score.items()}))
    return rows


def centre_scores(c: Clusters, n: int) -> dict[str, float]:
    """Calinski-Harabasz and Davies-Bouldin of clusters, from their sizes, means and distances."""
    full = c.size > 0
    size, centres, apart, k = c.size[full], c.centres[full], c.apart[full], int(full.sum())
    if not 2 <= k < n:
        return {"calinski_harabasz": np.nan, "davies_bouldin": np.nan}
    middle = (size[:, None] * centres).sum(axis=0) / n
    between = float((size * ((centres - middle) ** 2).sum(axis=1)).sum())
    out = {"calinski_harabasz": 1.0 if c.inertia == 0 else between * (n - k) / (c.inertia * (k - 1))}
    gap = np.sqrt(((centres[:, None] - centres) ** 2).sum(axis=2))
    if np.allclose(apart, 0) or np.allclose(gap, 0):
        return out | {"davies_bouldin": 0.0}
    gap[gap == 0] = np.inf
    ratio = (apart[:, None] + apart) / gap
    np.fill_diagonal(ratio, -np.inf)
    return out | {"davies_bouldin": float(ratio.max(axis=1).mean())}


def distinct_points(points: DataFrame) -> DataFrame:
    """(g, id, vec, labels, w): equal points with equal labels as one, named by the least id; their distances are equal."""
    same = points.groupBy("g", "vec", "labels").agg(F.min("id").alias("id"), F.count(F.lit(1)).cast("double").alias("w"))
    return same.select("g", "id", "vec", "labels", "w")


def tiles(points: DataFrame, sizes: dict[int, int], block: int) -> DataFrame:
    """(g, i, j, group, at, rows): each block in one row, once for each group of blocks of its graph."""
    blocks = F.create_map(*[F.lit(int(x)) for g, n in sizes.items() for x in (g, -(-n // block))])
    dealt = points.withColumn("blocks", F.element_at(blocks, F.col("g"))).withColumn("at", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    packed = dealt.groupBy("g", "at", "blocks").agg(F.collect_list(F.struct("id", "vec", "labels", "w")).alias("rows"))
    per = F.greatest(F.lit(1), F.least(F.ceil(F.col("blocks") / F.lit(GROUPS)), F.lit(GROUP_POINTS // block)))
    packed = packed.withColumn("group", F.floor(F.col("at") / per).cast("int")).withColumn("groups", F.ceil(F.col("blocks") / per).cast("int"))
    return packed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select(
        "g", F.least("group", "other").alias("i"), F.greatest("group", "other").alias("j"), "group", "at", "rows"
    )


def one_hot(labels: np.ndarray, ks: list[int]) -> np.ndarray:
    """The clusterings of the rows side by side."""
    return np.hstack([np.eye(k)[labels[:, c]] for c, k in enumerate(ks)])


def distance_sums(points: DataFrame, ks: dict[int, list[int]], sizes: dict[int, int], block: int = BLOCK) -> DataFrame:
    """(g, id, own, vec): each point's summed distances to the clusters of every clustering, in parts.

    A task gets two groups of blocks and returns one part for each of their points.
    """

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, i, j = (k.as_py() for k in key)
        held = []
        for batch in batches:
            for group, at, rows in zip(*(batch.column(c) for c in ("group", "at", "rows")), strict=True):
                ids, vec, labels, w = rows.values.flatten()
                Z = one_hot(matrix(labels), ks[g]) * w.to_numpy()[:, None]
                held.append((group.as_py(), at.as_py(), ids, matrix(vec), Z, np.zeros(Z.shape)))
        held.sort(key=lambda h: h[1])
        left, right = ([h for h in held if h[0] == of] for of in (i, j))
        for n, (_, at, _, X, Z, own) in enumerate(left):
            for _, to, _, Y, W, other in left[n:] if i == j else right:
                D = np.sqrt(squared(X, Y))
                if at == to:
                    np.fill_diagonal(D, 0.0)
                    own += D @ Z
                else:
                    own += D @ W
                    other += D.T @ Z
        for _, _, ids, _, _, own in held:
            yield pa.record_batch([pa.array(np.full(len(ids), g, "int32")), ids, lists(own)], names=["g", "id", "vec"])

    return tiles(points, sizes, block).groupBy("g", "i", "j").applyInArrow(run, "g int, id long, vec array<double>")


def silhouettes(points: DataFrame, ks: dict[int, list[int]], counts: dict[int, list[np.ndarray]], block: int = BLOCK) -> Matrices:
    """Mean silhouette of every clustering of each graph: ``points`` (g, id, vec, labels), ``counts`` its cluster sizes."""
    sizes = {g: int(of[0].sum()) for g, of in counts.items()}
    points = written(distinct_points(points), "distinct-points")
    apart = {r["g"]: r["n"] for r in points.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = distance_sums(points, ks, apart, block).withColumn("own", F.lit(False)).withColumn("p", F.lit(0))
    mine = F.concat(F.array("w"), F.col("labels").cast("array<double>"))
    own = points.select("g", "id", mine.alias("vec"), F.lit(True).alias("own"), F.lit(0).alias("p"))
    rows = own.unionByName(parts).repartition("g", "id").sortWithinPartitions("g", "id")

    def score(g, batch, rows):
        V = matrix(batch.column("vec"), rows)
        out, at = [], len(ks[g]) + 1
        for c, (k, size) in enumerate(zip(ks[g], counts[g], strict=True)):
            label, to = V[:, c + 1].astype(int), V[:, at : at + k]
            at += k
            here = np.arange(len(label))
            inner = to[here, label] / np.maximum(size[label] - 1, 1)
            mean = np.where(size > 0, to / np.maximum(size, 1), np.inf)
            mean[here, label] = np.inf
            outer = mean.min(axis=1)
            with np.errstate(all="ignore"):
                s = np.where(size[label] > 1, (outer - inner) / np.maximum(inner, outer), 0.0)
            out.append((V[:, 0] * np.nan_to_num(s)).sum())
        return np.array(out)

    sums = totals(rows.mapInArrow(_merged, "g int, id long, p int, vec array<double>"), score)
    dropped(points)
    n_found = {g: np.array([(s > 0).sum() for s in of]) for g, of in counts.items()}
    return {g: np.where((n_found[g] >= 2) & (n_found[g] < sizes[g]), v / sizes[g], np.nan) for g, v in sums.items()}


def modularities(points: DataFrame, pairs: DataFrame, ks: dict[int, list[int]]) -> Matrices:
    """Modularity of every clustering: ``pairs`` (g, src, dst) in both directions, without weights."""
    label = points.select("g", F.col("id").alias("src"), F.col("labels").alias("a"))
    most = max(len(of) for of in ks.values())
    joined = pairs.join(label, ["g", "src"]).join(label.select("g", F.col("src").alias("dst"), F.col("a").alias("b")), ["g", "dst"])
    same = [F.sum((F.get("a", F.lit(c)) == F.get("b", F.lit(c))).cast("long")).alias(f"s{c}") for c in range(most)]
    inner = {r.g: r for r in joined.groupBy("g").agg(F.count(F.lit(1)).alias("all"), *same).collect()}
    ends = pairs.join(label, ["g", "src"]).select("g", F.posexplode("a").alias("c", "label")).groupBy("g", "c", "label").agg(F.count(F.lit(1)).alias("n"))
    squares = {(r.g, r.c): r.s for r in ends.groupBy("g", "c").agg(F.sum(F.col("n").cast("double") ** 2).alias("s")).collect()}
    out = {}
    for g, of in ks.items():
        if g in inner:
            total = float(inner[g]["all"])
            out[g] = np.array([inner[g][f"s{c}"] / total - squares[g, c] / total**2 for c in range(len(of))])
        else:
            out[g] = np.full(len(of), np.nan)
    return out


# -- all of it -----------------------------------------------------------------------


def lots(sizes: dict[int, tuple[int, int]]) -> Iterator[list[int]]:
    """Graphs whose matrices fit LOT_CELLS together, one at least."""
    lot, held = [], 0
    for g, (p, _) in sorted(sizes.items()):
        cells = ((BLOCKS + 1) * p) ** 2
        if lot and held + cells > LOT_CELLS:
            yield lot
            lot, held = [], 0
        lot.append(g)
        held += cells
    if lot:
        yield lot


def communities(
    nodes: DataFrame, edges: DataFrame, n_nodes: dict[int, int], n_clusters: dict[int, list[int]],
    components: int | None, restarts: int,
) -> Iterator[tuple[list[tuple], DataFrame]]:
    """For each lot of graphs: (g, k, clusters found, inertia, four scores) of every k, and (g, node, k, community).

    ``nodes`` (g, node) and ``edges`` (g, src, dst), each pair once, of
    numbered graphs with ``n_nodes`` nodes; ``n_clusters`` are the k to try.
    """
    wanted = {g: min(n, components or max(2, int(np.sqrt(n)))) for g, n in n_nodes.items()}
    sizes = {g: (min(n_nodes[g], d + OVERSAMPLE), d) for g, d in wanted.items()}
    for lot in lots(sizes):
        inside = F.col("g").isin(lot)
        p = F.element_at(F.create_map(*[F.lit(int(x)) for g in lot for x in (g, sizes[g][0])]), F.col("g"))
        n = F.element_at(F.create_map(*[F.lit(int(x)) for g in lot for x in (g, n_nodes[g])]), F.col("g"))
        named = written(
            nodes.where(inside).select("g", "node", p.alias("p"), F.xxhash64("node").alias("hash"), F.monotonically_increasing_id().alias("id")),
            "spectral-nodes",
        )
        ids = {end: named.select("g", F.col("node").alias(end), F.col("id").alias(f"_{end}")) for end in ("src", "dst")}
        once = edges.where(inside).select("g", "src", "dst").distinct().join(ids["src"], ["g", "src"]).join(ids["dst"], ["g", "dst"])
        pairs = written(once.select("g", F.explode(F.array(F.struct(F.col("_src").alias("src"), F.col("_dst").alias("dst")), F.struct(F.col("_dst").alias("src"), F.col("_src").alias("dst")))).alias("e")).select("g", "e.*"), "spectral-edges")
        degree = pairs.groupBy("g", "src").agg(F.count(F.lit(1)).alias("deg"))
        lift: Column = F.coalesce("deg", F.lit(0)).cast("double") / F.greatest(n - 1, F.lit(1))
        diagonal = named.select("g", F.col("id").alias("src")).join(degree, ["g", "src"], "left").select("g", "src", F.col("src").alias("dst"), lift.alias("w"))
        weighted = written(pairs.withColumn("w", F.lit(1.0)).unionByName(diagonal), "spectral-weights")
        found = embedding(named, weighted, {g: sizes[g] for g in lot})
        points = written(found.join(named.select("g", "id", "hash"), ["g", "id"]).select("g", "id", "hash", "vec"), "spectral-embedding")
        dropped(found, weighted)
        ks = {g: sorted(n_clusters[g]) for g in lot}
        best = kmeans(points, ks, restarts)
        marked = written(labelled(points, best), "spectral-labels")
        dropped(points)
        rows = partition_scores(marked, pairs, ks)
        k_of = F.element_at(F.create_map(*[x for g in lot for x in (F.lit(g), F.array(*map(F.lit, ks[g])))]), F.col("g"))
        each = marked.withColumn("o", F.explode(F.arrays_zip(k_of.alias("k"), F.col("labels"))))
        labels = each.select("g", "id", F.col("o.k").alias("k"), F.col("o.labels").alias("community")).join(named.select("g", "id", "node"), ["g", "id"])
        labels = written(labels.select("g", "node", "k", "community"), "spectral-communities")
        dropped(marked, pairs, named)
        yield rows, labels
