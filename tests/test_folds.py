"""Folds that aren't sums, many targets at once, and refreshes of what is stale only."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sylvaframe import fixtures as fx
from sylvaframe.operators import rank, stats
from sylvaframe.plans import closure as cl
from sylvaframe.plans.blocks import block_pairs
from sylvaframe.schema import Tables

NODES = "node_id long, parent_id long"


def chosen_kids(parent_of, k):
    kids = defaultdict(list)
    for n, p in parent_of.items():
        if p is not None:
            kids[p].append(n)
    return {p: sorted(c, key=lambda n: ((n * 2654435761) % 4294967296, n))[:k] for p, c in kids.items()}


def plain_types(parent_of, sample, k):
    """Level by level, deepest first: turns through the lists of the chosen children."""
    kids, found = chosen_kids(parent_of, k), {}

    def depth(n):
        d = 0
        while parent_of[n] is not None:
            n, d = parent_of[n], d + 1
        return d

    for n in sorted(parent_of, key=depth, reverse=True):
        if n not in kids:
            found[n] = sample.get(n, [])[:k]
            continue
        lists = [found[c] for c in kids[n]]
        found[n] = [x[p] for p in range(k) for x in lists if p < len(x)][:k]
    return found


def check_types(spark, nodes, assignments, objects, k):
    t = Tables(nodes, assignments, objects)
    got = defaultdict(dict)
    for r in stats.type_objects(t, k).collect():
        got[r.node_id][r.pos] = r.object_id
    rand = {r.object_id: r.rand for r in objects.collect()}
    sample = defaultdict(list)
    for r in sorted(assignments.collect(), key=lambda r: (rand[r.object_id], r.object_id)):
        sample[r.node_id].append(r.object_id)
    want = plain_types({r.node_id: r.parent_id for r in nodes.collect()}, sample, k)
    assert {n: [x[p] for p in sorted(x)] for n, x in got.items()} == {n: x for n, x in want.items() if x}


def test_type_objects_of_deep_tree(spark):
    t = fx.deep_with_vectors(spark, "/root/testdata/sf0.001")
    check_types(spark, t.nodes.select("node_id", "parent_id"), t.assignments, t.objects, 9)


def test_type_objects_of_made_trees(spark):
    rng = np.random.default_rng(3)
    parents = [(0, None)] + [(n, int(rng.integers(max(0, n - 6), n))) for n in range(1, 150)]
    ids = [(f"o{k}", int(rng.integers(0, 150))) for k in range(500)]
    objects = spark.createDataFrame([(o, [0.0], float(rng.random())) for o, _ in ids], "object_id string, vector array<double>, rand double")
    check_types(spark, spark.createDataFrame(parents, NODES), spark.createDataFrame(ids, "object_id string, node_id long"), objects, 3)


def chain(spark, n):
    return spark.range(n).select(F.col("id").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))


def test_chain_of_ten_thousand(spark):
    n = 10_000
    nodes, ends = chain(spark, n), [0, 1, n // 2, n - 1]
    objects = spark.createDataFrame([(f"o{k}", [float(k)], k / 10) for k in ends], "object_id string, vector array<double>, rand double")
    t = Tables(nodes, spark.createDataFrame([(f"o{k}", k) for k in ends], "object_id string, node_id long"), objects)
    types = stats.type_objects(t)
    assert types.count() == n and [r.object_id for r in types.select("object_id").distinct().collect()] == [f"o{n - 1}"]
    found = {r.node_id: r.prototypes for r in stats.prototypes(t, k=2).filter(F.col("node_id").isin(0, 1, 2, n - 1)).collect()}
    totals = {k: (sum(p.support for p in v), sum(p.support * p.vector[0] for p in v)) for k, v in found.items()}
    assert totals == {0: (4.0, float(sum(ends))), 1: (3.0, float(sum(ends))), 2: (2.0, float(n // 2 + n - 1)), n - 1: (1.0, float(n - 1))}
    assert all(len(v) <= 2 for v in found.values())


def test_prototypes_of_far_groups_are_found(spark):
    # Four far groups below different levels: every merge keeps them apart.
    parents = [(0, None), (1, 0), (2, 1), (3, 2), (4, 3)]
    rng = np.random.default_rng(0)
    rows = [(f"o{g}_{k}", g, [100.0 * g + float(rng.normal()), float(rng.normal())]) for g in range(1, 5) for k in range(30)]
    objects = spark.createDataFrame([(o, v, float(rng.random())) for o, _, v in rows], "object_id string, vector array<double>, rand double")
    t = Tables(spark.createDataFrame(parents, NODES), spark.createDataFrame([(o, g) for o, g, _ in rows], "object_id string, node_id long"), objects)
    top = {r.node_id: r.prototypes for r in stats.prototypes(t, k=4).collect()}[0]
    assert sorted(round(p.vector[0] / 100) for p in top) == [1, 2, 3, 4] and sorted(p.support for p in top) == [30.0] * 4


def test_many_targets_equal_each_one(spark):
    t = fx.vectors(spark, "/root/testdata/sf0.001")
    targets = spark.createDataFrame([(10,), (12,), (19,), (1,), (12,), (77,)], "node_id long")
    protos = t.assignments.filter("cast(object_id as bigint) < 60").join(t.objects, "object_id").select("node_id", "vector")
    got = defaultdict(list)
    for r in rank.recommend_objects_many(t, targets, protos, 30).orderBy("target_id", "rank").collect():
        got[r.target_id].append((r.object_id, round(r.distance, 9)))
    for k in (10, 12, 19, 1):
        own = protos.filter(F.col("node_id") == k).select("vector")
        want = [] if own.isEmpty() else [(r.object_id, round(r.distance, 9)) for r in rank.recommend_objects(t, k, own, 30).collect()]
        assert got[k] == want
    centroids = stats.centroids(t).filter("node_id <> 13")
    kids = defaultdict(list)
    for r in rank.recommend_children_many(t, targets, centroids, 64, 3).orderBy("target_id", "rank").collect():
        kids[r.target_id].append((r.node_id, round(r.distance, 9)))
    for k in (10, 12, 19, 1):
        assert kids[k] == [(r.node_id, round(r.distance, 9)) for r in rank.recommend_children(t, k, centroids, 64, 3).collect()]


def test_many_targets_in_small_blocks_ties_refusals_and_null_vectors(spark, monkeypatch):
    monkeypatch.setattr(rank, "MEMBER_ROWS", 7)
    monkeypatch.setattr(rank, "TARGET_ROWS", 2)
    nodes = spark.createDataFrame([(0, None)] + [(n, 0) for n in range(1, 8)], NODES)
    objects = spark.createDataFrame([(f"o{k:03d}", None if k % 17 == 0 else [float(k % 5)]) for k in range(100)], "object_id string, vector array<double>")
    t = Tables(nodes, objects.select("object_id", F.lit(0).cast("long").alias("node_id")), objects, spark.createDataFrame([(n, f"o{k:03d}") for n in range(1, 8) for k in range(100) if k % 7 == n % 7], "node_id long, object_id string"))
    protos = spark.createDataFrame([(n, [n / 2]) for n in range(1, 8)] + [(1, [4.0])], "node_id long, vector array<double>")
    got = {(r.target_id, r["rank"]): (r.object_id, r.distance) for r in rank.recommend_objects_many(t, nodes.filter("node_id > 0").select("node_id"), protos, 95).collect()}
    for n in range(1, 8):
        want = [tuple(r) for r in rank.recommend_objects(t, n, protos.filter(F.col("node_id") == n).select("vector"), 95).collect()]
        assert [got[(n, k + 1)] for k in range(len(want))] == want and (n, len(want) + 1) not in got


def test_blocks_meet_once(spark):
    left = spark.createDataFrame([(k % 2, k) for k in range(50)], "key int, x long")
    right = spark.createDataFrame([(k % 3, k) for k in range(20)], "key int, y long")
    both = block_pairs(left, right, ["key"], "x", "y", lambda a, b: a[["x"]].merge(b[["y"]], how="cross"), "x long, y long", 4, 3)
    assert sorted(map(tuple, both.collect())) == sorted((a, b) for a in range(50) for b in range(20) if a % 2 == b % 3)


def test_refresh_reads_stale_nodes_only(spark):
    nodes = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 0), (4, 3)], NODES).withColumns({
        "cache_valid": F.col("node_id").isin(1, 4), "_n_objects_deep": F.when(F.col("node_id") == 1, 700).when(F.col("node_id") == 4, 7).cast("long"),
        "_centroid": F.when(F.col("node_id") == 1, F.array(F.lit(2.0))).when(F.col("node_id") == 4, F.array(F.lit(9.0))), "_n_vectors": F.when(F.col("node_id") == 1, 70.0).when(F.col("node_id") == 4, 7.0),
    })
    objects = spark.createDataFrame([("a", [1.0]), ("b", [5.0]), ("c", [50.0]), ("d", [60.0])], "object_id string, vector array<double>")
    t = Tables(nodes, spark.createDataFrame([("a", 0), ("b", 3), ("c", 2), ("d", 4)], "object_id string, node_id long"), objects)
    got = {r.node_id: (r._n_objects, r._n_objects_deep, r._centroid, r.cache_valid) for r in stats.consolidate(t, 0, 0).collect()}
    # 2 lies below a valid node and isn't come to; 1 and 4 keep what they hold, though it is false.
    assert got[2] == (None, None, None, False) and got[1][1:3] == (700, [2.0]) and got[4][1:3] == (7, [9.0])
    assert got[3] == (1, 8, [pytest.approx((5 + 63) / 8)], True) and got[0] == (1, 709, [pytest.approx((1 + 140 + 68) / 79)], True)


def test_refresh_of_prototypes_takes_cached_ones(spark):
    proto = F.array(F.struct(F.array(F.lit(8.0)).alias("vector"), F.lit(3.0).alias("support")))
    nodes = spark.createDataFrame([(0, None), (1, 0)], NODES).withColumns({"cache_valid": F.col("node_id") == 1, "_n_objects_deep": F.when(F.col("node_id") == 1, 3).cast("long"), "_prototypes": F.when(F.col("node_id") == 1, proto)})
    objects = spark.createDataFrame([("a", [1.0], 0.1), ("b", [99.0], 0.2)], "object_id string, vector array<double>, rand double")
    t = Tables(nodes, spark.createDataFrame([("a", 0), ("b", 1)], "object_id string, node_id long"), objects)
    row = stats.consolidate(t, 0, with_prototypes=True, return_="node").first()
    assert sorted((p.vector[0], p.support) for p in row._prototypes) == [(1.0, 1.0), (8.0, 3.0)] and row._n_objects_deep == 4


def test_paths_and_subtrees_of_many(spark):
    nodes = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 1), (4, 3)], NODES)
    ids = spark.createDataFrame([(4,), (1,), (1,), (9,)], "x long")
    assert {(r.target_id, r.node_id, r.level) for r in cl.ancestors(nodes, ids).collect()} == {(4, 4, 0), (4, 3, -1), (4, 1, -2), (4, 0, -3), (1, 1, 0), (1, 0, -1)}
    assert {r.node_id: list(r.path) for r in cl.paths(nodes, ids).collect()} == {4: [0, 1, 3, 4], 1: [0, 1]}
    assert {(r.target_id, r.node_id, r.level) for r in cl.subtree(nodes, ids).collect()} == {(4, 4, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)}
    assert cl.subtree(nodes, ids.limit(0)).count() == 0
    with pytest.raises(cl.CycleError):
        cl.ancestors(spark.createDataFrame([(0, 1), (1, 0)], NODES), ids)
