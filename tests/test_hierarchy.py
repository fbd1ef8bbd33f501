"""The density hierarchy against a plain one: Kruskal merges, condensing from the top, the choice by recursion."""

import sys

import numpy as np
import pytest

from sylvaframe.operators import hierarchy, recluster


def plain_labels(ids, edges, size, method):
    """Labels of a spanning tree's edges (a, b, w), as the clusters' definition says."""
    number = {x: k for k, x in enumerate(sorted(ids))}
    up, kids, weight, count = {}, {}, {}, {k: 1 for k in range(len(ids))}

    def top(x):
        while x in up:
            x = up[x]
        return x

    for rank, (w, u, v) in enumerate(sorted((w, number[a], number[b]) for a, b, w in edges)):
        node = len(ids) + rank
        kids[node], weight[node] = (top(u), top(v)), w
        count[node] = sum(count[c] for c in kids[node])
        for c in kids[node]:
            up[c] = node
    lam = lambda node: 1 / max(weight[node], 1e-12)
    clusters = []  # [parent, birth, stability, points, node]

    def points_of(x):
        stack, out = [x], []
        while stack:
            y = stack.pop()
            if y in kids:
                stack += kids[y]
            else:
                out.append(y)
        return out

    todo = [(r, None, 0.0) for r in {top(k) for k in number.values()} if count[r] >= size]
    while todo:
        node, parent, birth = todo.pop()
        me, stability, points = len(clusters), 0.0, []
        clusters.append(None)
        while True:
            large = [c for c in kids[node] if count[c] >= size]
            for c in kids[node]:
                if count[c] < size or len(large) == 2:
                    stability += count[c] * (lam(node) - birth)
                    points += points_of(c) if count[c] < size else []
            if len(large) != 1:
                todo += [(c, me, lam(node)) for c in large]
                break
            node = large[0]
        clusters[me] = (parent, stability, points)
    below = {k: [j for j, c in enumerate(clusters) if c[0] == k] for k in range(len(clusters))}

    def best(k):
        parts = [best(j) for j in below[k]]
        total = sum(v for v, _ in parts)
        picked = [x for _, xs in parts for x in xs]
        if clusters[k][0] is not None and (not below[k] if method == "leaf" else clusters[k][1] >= total):
            return clusters[k][1], [k]
        return max(total, clusters[k][1]), picked

    chosen = [x for k, c in enumerate(clusters) if c[0] is None for x in best(k)[1]]

    def inside(k):
        return clusters[k][2] + [p for j in below[k] for p in inside(j)]

    names = sorted(ids)
    groups = sorted(sorted(names[p] for p in (inside(k) if method == "eom" else clusters[k][2])) for k in chosen)
    return {x: n for n, g in enumerate(groups) for x in g}


def made_tree(seed, n, kind):
    rng = np.random.default_rng(seed)
    ids = [f"p{k:04d}" for k in range(n)]
    weights = rng.random(n).round(2) if kind == "ties" else rng.random(n) ** 3
    parent = [k - 1 if kind == "chain" else int(rng.integers(max(0, k - 5) if kind == "long" else 0, k)) for k in range(1, n)]
    return ids, [(ids[k], ids[p], float(weights[k])) for k, p in enumerate(parent, 1)]


def found_labels(spark, ids, edges, size, method, local):
    points = spark.createDataFrame([(x,) for x in ids], "object_id string")
    forest = spark.createDataFrame(edges, "a string, b string, w double")
    return {r.object_id: r.label for r in hierarchy.clusters_of(points, forest, size, method, local).collect()}


@pytest.mark.parametrize("kind,n,size,local", [("random", 120, 4, 4096), ("chain", 150, 5, 20), ("ties", 130, 3, 4096), ("long", 200, 4, 30)])
def test_labels_against_plain_hierarchy(spark, kind, n, size, local):
    sys.setrecursionlimit(10_000)
    ids, edges = made_tree(n, n, kind)
    for method in ("leaf", "eom"):
        assert found_labels(spark, ids, edges, size, method, local) == plain_labels(ids, edges, size, method)


def test_merges_by_halves_equal_those_of_one_task(spark):
    ids, edges = made_tree(1, 300, "long")
    rows = sorted((w, int(a[1:]), int(b[1:])) for a, b, w in edges)
    frame = spark.createDataFrame([(u, v, w, k) for k, (w, u, v) in enumerate(rows)], "u long, v long, w double, rank long")
    merges = lambda local: {r.node_id: ({r.left, r.right}, r.w) for r in hierarchy.dendrogram(frame, 300, local).collect()}
    assert merges(40) == merges(4096)


def test_best_cuts_on_a_long_chain_of_clusters(spark):
    # A caterpillar: each inner cluster has a leaf beside the next one.
    n, rng = 60, np.random.default_rng(2)
    own = rng.random(2 * n)
    rows = [(k, k - 1 if k else None, float(own[k])) for k in range(n)] + [(n + k, k, float(own[n + k]) / 8) for k in range(n)]
    got = {r.node_id: (r.value, r.below) for r in hierarchy.best_cuts(spark.createDataFrame(rows, "node_id long, parent_id long, own double")).collect()}
    value = {n + k: float(own[n + k]) / 8 for k in range(n)}
    for k in reversed(range(n)):
        under = value[n + k] + (value[k + 1] if k + 1 < n else 0.0)
        value[k] = max(float(own[k]), under)
        assert got[k] == (pytest.approx(value[k]), pytest.approx(under))


def test_no_split_no_points_and_null_features(spark):
    ids, edges = made_tree(0, 6, "chain")
    assert found_labels(spark, ids, edges, 4, "leaf", 4096) == {} and found_labels(spark, ids, edges, 9, "eom", 4096) == {}
    with pytest.raises(ValueError):
        found_labels(spark, ids, edges, 1, "leaf", 4096)
    rows = [(f"a{k}", [float(k), 0.0]) for k in range(4)] + [(f"b{k}", [100.0 + k, 1.0]) for k in range(4)] + [("none", None)]
    got = {r.object_id: r.label for r in recluster.density_cluster(spark.createDataFrame(rows, "object_id string, features array<double>"), 3).collect()}
    assert {got[f"a{k}"] for k in range(4)} == {0} and {got[f"b{k}"] for k in range(4)} == {1} and got["none"] == -1
    empty = spark.createDataFrame([], "object_id string, features array<double>")
    assert recluster.density_cluster(empty, 3).count() == 0


def grouped_points(spark, n=400, dims=2):
    rng = np.random.default_rng(5)
    centres = rng.random((8, dims)) * 100
    rows = [(f"p{k:04d}", (centres[k % 8] + rng.normal(size=dims)).tolist()) for k in range(n)] + [(f"q{k}", centres[0].tolist()) for k in range(30)]
    return rows, spark.createDataFrame(rows, "object_id string, vector array<double>")


def test_index_leaves_out_far_blocks_only(spark, monkeypatch):
    monkeypatch.setattr(recluster, "BLOCK", 16)
    rows, points = grouped_points(spark)
    index, report = recluster.metric_index(points, 24), {}
    ids, x = [r[0] for r in rows], np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    got = {}
    for r in recluster.neighbours(points, 4, index, report).collect():
        got.setdefault(r.object_id, []).append((r["rank"], r.d))
    assert all(np.allclose([v for _, v in sorted(got[ids[i]])], np.sort(d[i])[:4], atol=1e-5) for i in range(len(ids)))
    assert 0 < report["compared"] < 0.5 * report["all"]


def test_spanning_tree_over_an_index(spark, monkeypatch):
    monkeypatch.setattr(recluster, "BLOCK", 16)
    monkeypatch.setattr(recluster, "PER_PIVOT", 16)
    rows, points = grouped_points(spark, 150)
    x = np.array([r[1] for r in rows])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    inside, total = np.zeros(len(x), bool), 0.0
    inside[0], near = True, d[0].copy()
    for _ in range(len(x) - 1):
        near[inside] = np.inf
        k = int(near.argmin())
        total, inside[k] = total + near[k], True
        near = np.minimum(near, d[k])
    found = recluster.density_forest(points, 1).collect()
    # A core distance for one neighbour is at most any link's length, so these are plain distances.
    assert len(found) == len(x) - 1 and sum(r.w for r in found) == pytest.approx(total, abs=1e-4)
