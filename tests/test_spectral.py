"""Communities of graphs that no task holds, against those that one task computes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratanet.operators import communities as C
from stratanet.operators import metrics as H
from stratanet.operators import spectral as S

GROUPS = {"a": (3, 12), "b": (4, 10)}
SCHEMA = "layer string, src string, dst string, weight double, strength double"


@pytest.fixture(scope="module")
def planted(spark):
    """Dense groups with few edges between them; layer b also has a node without edges."""
    rng = np.random.default_rng(5)
    nodes, edges = [("b", "alone")], []
    for layer, (groups, size) in GROUPS.items():
        names = [f"n{i:02d}" for i in range(groups * size)]
        nodes += [(layer, v) for v in names]
        for i, u in enumerate(names):
            for j in range(i + 1, len(names)):
                if rng.random() < (0.85 if i // size == j // size else 0.04):
                    edges.append((layer, u, names[j], 1.0, 1.0))
    return spark.createDataFrame(nodes, "layer string, node string"), spark.createDataFrame(edges, SCHEMA)


def parts(labels, by):
    out = {}
    for r in labels.collect():
        out.setdefault(tuple(r[k] for k in by), {}).setdefault(r["community"], set()).add(r["node"])
    return {k: frozenset(map(frozenset, v.values())) for k, v in out.items()}


def tables(planted, **more):
    tried, labels = C.clusterings(*planted, ("layer",), 5, **more)
    return {(r["layer"], r["k"]): r.asDict() for r in tried.collect()}, parts(labels, ("layer", "k"))


def test_both_paths_find_the_planted_groups_with_equal_scores(planted, monkeypatch):
    small, small_parts = tables(planted)
    monkeypatch.setattr(H, "TASK_NODES", 2)
    large, large_parts = tables(planted)
    assert small.keys() == large.keys()
    for layer, (groups, _) in GROUPS.items():
        key = (layer, groups)
        assert small_parts[key] == large_parts[key]
        for name in ("inertia", *C.SCORES):
            assert large[key][name] == pytest.approx(small[key][name], rel=1e-4)
    for key, row in large.items():
        assert row["inertia"] <= 1.05 * small[key]["inertia"]
        assert {c: row[c] for c in ("is_fixed", "searched")} == {c: small[key][c] for c in ("is_fixed", "searched")}
        assert sum(map(len, large_parts[key])) == sum(map(len, small_parts[key]))


def test_methods_choose_alike_on_both_paths(planted, monkeypatch):
    def chosen():
        found, best = C.layer_communities(*planted, methods=("MODULARITY", "SILHOUETTE"), max_clusters=5)
        return parts(found.where("method = 'MODULARITY'"), ("layer",)), {(r["layer"], r["method"]): r["n_clusters"] for r in best.collect()}

    small = chosen()
    monkeypatch.setattr(H, "TASK_NODES", 2)
    monkeypatch.setattr(S, "LOT_CELLS", 10)  # a lot for each graph
    assert chosen() == small
    assert small[1]["a", "MODULARITY"] == 3 and small[1]["b", "MODULARITY"] >= 4


def test_embedding_spans_what_the_dense_one_does(spark, planted):
    nodes, edges = (t.where("layer = 'a'") for t in planted)
    names = sorted(r["node"] for r in nodes.collect())
    at = {v: i for i, v in enumerate(names)}
    A = np.zeros((len(names), len(names)))
    for r in edges.collect():
        A[at[r["src"]], at[r["dst"]]] = A[at[r["dst"]], at[r["src"]]] = 1.0
    want = C.embed(A, 6)
    n = len(names)
    B = A + np.diag(A.sum(axis=1) / (n - 1))
    numbered = spark.createDataFrame([(0, i, 10, v) for v, i in at.items()], "g int, id long, p int, node string")
    rows = [(0, int(i), int(j), float(B[i, j])) for i in range(n) for j in range(n) if B[i, j] or i == j]
    found = S.embedding(numbered, spark.createDataFrame(rows, "g int, src long, dst long, w double"), {0: (10, 6)})
    X = np.array([r["vec"] for r in found.orderBy("id").collect()])
    assert X.shape == want.shape
    assert np.abs(X @ X.T - want @ want.T).max() < 1e-4


def points_of(spark, X, labels):
    rows = [(0, i, i * 7919, x.tolist(), lab) for i, (x, lab) in enumerate(zip(X, labels, strict=True))]
    return spark.createDataFrame(rows, "g int, id long, hash long, vec array<double>, labels array<int>").repartition(3)


@pytest.mark.parametrize("block", [5, 1000])
def test_scores_do_not_depend_on_the_tiles(spark, block):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(40, 3))
    labels = [[int(i % 3), int(i % 4) if i else 5] for i in range(40)]  # of six clusters one has a single point, one none
    A = np.triu(rng.random((40, 40)) < 0.2, 1).astype(float)
    A += A.T
    pairs = spark.createDataFrame([(0, int(i), int(j)) for i, j in zip(*np.nonzero(A), strict=True)], "g int, src long, dst long")
    rows = S.partition_scores(points_of(spark, X, labels), pairs, {0: [3, 6]}, block=block)
    for c, (_, k, found, inertia, score) in enumerate(rows):
        own = np.array([r[c] for r in labels])
        want = C.cluster_scores(A, X, own)
        assert found == len(set(own.tolist())) and k == (3, 6)[c]
        assert {s: score[s] for s in C.SCORES} == pytest.approx(want)
        centres = {v: X[own == v].mean(axis=0) for v in set(own.tolist())}
        assert inertia == pytest.approx(sum(((x - centres[v]) ** 2).sum() for x, v in zip(X, own, strict=True)))


def test_kmeans_is_as_good_as_in_one_task(spark):
    rng = np.random.default_rng(4)
    X = np.vstack([rng.normal(size=(30, 2)) * 0.3 + c for c in ((0, 0), (4, 0), (0, 4), (5, 5))])
    points = points_of(spark, X, [[0]] * len(X))
    best = S.kmeans(points, {0: [2, 3, 4]}, restarts=10)[0]
    for k, c in best.items():
        assert c.settled and c.inertia <= C.kmeans(X, k)[1] * (1 + 1e-9)


def test_equal_points_and_fewer_points_than_clusters(spark):
    points = points_of(spark, np.ones((4, 2)), [[0]] * 4)
    best = S.kmeans(points, {0: [2, 6]}, restarts=2)[0]
    assert best[6].inertia == 0 and best[6].size.sum() == 4
    assert S.labelled(points, {0: best}).count() == 4


def test_multiplex_and_windows_above_the_bound(spark, monkeypatch):
    """What raised for graphs of more than some nodes has a row for every node."""
    monkeypatch.setattr(H, "TASK_NODES", 2)
    edges = []
    for w in (0, 1):
        for lo in "ab":
            names = [f"{lo}{i}" for i in range(5)]
            edges += [(w, u, v, 1.0, 1.0) for i, u in enumerate(names) for v in names[i + 1 :]]
    e = spark.createDataFrame(edges, "window_idx int, src string, dst string, weight double, strength double")
    nodes = spark.createDataFrame([(w, f"{c}{i}") for w in (0, 1) for c in "ab" for i in range(5)], "window_idx int, node string")
    found, best = C.window_communities(nodes, e, methods=("MODULARITY",), max_clusters=4)
    want = frozenset({frozenset(f"a{i}" for i in range(5)), frozenset(f"b{i}" for i in range(5))})
    assert parts(found, ("window_idx",)) == {(0,): want, (1,): want}
    assert {r["n_clusters"] for r in best.collect()} == {2}


def test_modularity_is_clustered_again_at_the_number_found(spark):
    tried = spark.createDataFrame(
        [("g", 2, False, True, 2, 1.0, 0.1, 0.2, 1.0, 1.0), ("g", 3, True, True, 2, 1.0, 0.1, 0.4, 1.0, 1.0)],
        "layer string, k int, is_fixed boolean, searched boolean, n_found int, inertia double, " + ", ".join(f"{s} double" for s in C.SCORES),
    )
    labels = spark.createDataFrame([("g", k, "x", k) for k in (2, 3)], "layer string, k int, node string, community int")
    best = C.choose(tried, ("layer",), ("MODULARITY", "FIXED"))
    assert {r["method"]: (r["k"], r["n_clusters"], r["score"]) for r in best.collect()} == {"MODULARITY": (2, 2, 0.4), "FIXED": (3, 2, 0.1)}
    assert {r["method"]: r["community"] for r in C.members(best, labels, ("layer",)).collect()} == {"MODULARITY": 2, "FIXED": 3}


def test_written_tables_are_taken_away(spark, tmp_path):
    from pathlib import Path

    from stratanet.session import dropped, written

    table = written(spark.range(3), "some")
    folder = Path(table._scratch_path.removeprefix("file:"))
    assert table.count() == 3 and folder.exists()
    dropped(table)
    assert not folder.exists()


def test_copies_of_points_are_weighed_and_parts_are_one_for_each_group(spark):
    rng = np.random.default_rng(6)
    X = np.repeat(rng.normal(size=(30, 2)), 4, axis=0)
    labels = [[int(i // 4 % 3), int(i % 2)] for i in range(len(X))]  # copies with equal and with other labels
    points = points_of(spark, X, labels)
    counts = {0: [np.bincount([r[c] for r in labels], minlength=k) for c, k in enumerate((3, 2))]}
    own = np.array(labels)
    for block in (2, 1000):
        got = S.silhouettes(points, {0: [3, 2]}, counts, block=block)[0]
        for c in range(2):
            want = C.cluster_scores(np.zeros((len(X), len(X))), X, own[:, c])["silhouette"]
            assert got[c] == pytest.approx(want, abs=1e-6)
    merged = S.distinct_points(points)
    assert merged.count() == 60 and merged.where("w = 2").count() == 60
    assert S.distance_sums(merged, {0: [3, 2]}, {0: 60}, block=2).count() <= 60 * S.GROUPS
